"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode (tests) a temporary one will do; on a cluster it must be named."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="larkfield-")
    sc.setCheckpointDir(made)
    return made


class Stored:
    """A frame written to the shared folder as Parquet and read again, so that its lineage ends there."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/larkfield-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; only for tables that no later plan reads."""
        jvm = self.df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps whose results are stored; it waits for the driver's GC."""
    spark.sparkContext._jvm.System.gc()


BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default, as texts may be long; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drops the columns that an operator is about to write (names compare without case, as Spark does)."""
    taken = {n.lower() for n in names}
    return df.select([f"`{c}`" for c in df.columns if c.lower() not in taken])


def append_columns(
    df: DataFrame,
    column: str,
    fields: Sequence[T.StructField],
    compute: Callable[..., dict[str, Sequence]],
    also: Sequence[str] = (),
) -> DataFrame:
    """Adds columns that ``compute`` derives from the values of one column (and of those in ``also``), batch by batch.

    Other columns pass through as Arrow arrays, untouched. Columns of the same name are replaced.
    """
    small_batches(df.sparkSession)
    base = without(df, [f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])
    names = [f.name for f in fields]
    types = [_arrow(f.dataType) for f in fields]
    lower = [c.lower() for c in base.columns]
    at = [lower.index(c.lower()) for c in (column, *also)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(*(batch.column(k).to_pylist() for k in at))
            arrays = [pa.array(made[n], type=t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return base.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return simple[kind.simpleString()]
