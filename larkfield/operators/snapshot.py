"""Tables kept current by snapshots: change detection, upserts, replacement of a file's rows, cascades, versions.

A table is a folder of versions and of numbered pointers. A writer writes a new version and then creates the next
pointer, which only one of several writers can; readers take the highest whole pointer, so they always see a whole
table, and a failed writer leaves nothing behind but an unused folder. Versions are kept while one of the last ``KEEP``
pointers names them, for readers that opened them before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION, KEEP = 4, 3


def file_id(path: Column) -> Column:
    """An id that stays with a path through all rewrites."""
    return F.xxhash64(path)


def backlog(disk: DataFrame, snapshot: DataFrame) -> DataFrame:
    """disk(path, mtime, size, ...) with ``change``: new, changed, unfinished or unchanged; snapshot has symbols_done."""
    old = snapshot.select("path", F.col("mtime").alias("__m"), F.col("size").alias("__s"), F.col("symbols_done").alias("__d"), F.lit(True).alias("__old"))
    rows = disk.join(old, "path", "left")
    differs = ~(F.col("mtime").eqNullSafe(F.col("__m")) & F.col("size").eqNullSafe(F.col("__s")))
    change = F.when(F.col("__old").isNull(), "new").when(differs, "changed").when(~F.coalesce("__d", F.lit(False)), "unfinished").otherwise("unchanged")
    return rows.withColumn("change", change).drop("__m", "__s", "__d", "__old")


def work_list(changes: DataFrame, priority: DataFrame) -> DataFrame:
    """Paths to work on: those asked for first, then the backlog without them; ``turn`` 0 or 1."""
    first = priority.select("path").distinct().withColumn("turn", F.lit(0))
    rest = changes.where("change <> 'unchanged'").select("path").join(first, "path", "left_anti").withColumn("turn", F.lit(1))
    return first.unionByName(rest)


def deleted(disk: DataFrame, snapshot: DataFrame) -> DataFrame:
    return snapshot.join(disk.select("path"), "path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """``new`` wins on equal keys; columns that only one side has become null on the other."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_newest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest ``version`` of each key; ``new`` wins where versions are equal."""
    touched = new.select(key).distinct()
    rows = old.join(touched, key, "left_semi").withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "__new"]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, "__new")).alias("__r")).select("__r.*")
    return old.join(touched, key, "left_anti").unionByName(best, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The first write of a key wins: old rows, then new ones by ``order``."""
    keys = [key] if isinstance(key, str) else key
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), order).alias("__r")).select("__r.*")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str, unique: list[str] | None = None, parents: DataFrame | None = None) -> DataFrame:
    """Swaps all rows of the parents in ``new`` (or in ``parents``, which clears those without new rows)."""
    gone = (parents if parents is not None else new).select(parent).distinct()
    fresh = new.dropDuplicates(unique) if unique else new
    return old.join(gone, parent, "left_anti").unionByName(fresh)


def cascade(children: DataFrame, parents: DataFrame, *links: tuple[str, str]) -> DataFrame:
    """Children whose every link (child column, parent column) still has its parent."""
    for child, parent in links:
        keys = parents.select(F.col(parent).alias(child)).distinct()
        children = children.join(keys, child, "left_semi")
    return children


class Conflict(RuntimeError):
    """Another writer was faster."""


class SnapshotTable:
    """Versions of one table under ``root``, read and written by Spark alone.

    ``migrations`` maps a schema version to what turns a frame of it into one of the next version; a table of an older
    schema without a way to this one reads as not there.
    """

    def __init__(self, spark: SparkSession, root: str, schema_version: int = SCHEMA_VERSION, migrations: Mapping[int, Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.root, self.schema_version, self.migrations = spark, root.rstrip("/"), schema_version, dict(migrations or {})

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _pointers(self) -> list[int]:
        fs, path = self._fs("pointers")
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit())

    def _pointer(self, number: int) -> dict | None:
        """None if the pointer is not whole: its writer has failed or is still writing."""
        fs, path = self._fs(f"pointers/{number:012d}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def _current(self) -> tuple[int, dict]:
        """The highest pointer taken, and the content of the highest whole one."""
        numbers = self._pointers()
        for number in reversed(numbers):
            found = self._pointer(number)
            if found is not None:
                return numbers[-1], found
        return (numbers[-1] if numbers else 0), {}

    def _path_from(self, version: int) -> bool:
        return version <= self.schema_version and all(v in self.migrations for v in range(version, self.schema_version))

    def meta(self) -> dict[str, str]:
        """The pointer: version, schema_version and what ``set_meta`` added; empty where nothing can be read."""
        found = self._current()[1]
        return found if found.get("version") and self._path_from(int(found["schema_version"])) else {}

    def get_meta(self, key: str) -> str | None:
        return self._current()[1].get(f"meta:{key}")

    def set_meta(self, key: str, value: str | None) -> None:
        """Sets a value beside the table, or drops it."""
        after, found = self._current()
        found = {k: v for k, v in found.items() if k != f"meta:{key}"} | ({f"meta:{key}": value} if value is not None else {})
        self._commit(after, found)

    def read(self) -> DataFrame | None:
        found = self.meta()
        if not found:
            return None
        df = self.spark.read.parquet(f"{self.root}/{found['version']}")
        for version in range(int(found["schema_version"]), self.schema_version):
            df = self.migrations[version](df)
        return df

    def write(self, df: DataFrame, partition_by: str | None = None, meta: Mapping[str, str] | None = None, after: Callable[[], Mapping[str, str]] | None = None) -> DataFrame:
        """Writes and commits a version; fails with ``Conflict`` if another writer committed since it began.

        ``meta`` is set with it, and what ``after`` gives once the rows are written.
        """
        number, found = self._current()
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{version}")
        kept = {k: v for k, v in found.items() if k.startswith("meta:")} | {f"meta:{k}": v for k, v in {**(meta or {}), **(after() if after else {})}.items()}
        self._commit(number, {"version": version, "schema_version": str(self.schema_version), **kept})
        self._clean()
        return self.spark.read.parquet(f"{self.root}/{version}")

    def _commit(self, after: int, content: dict) -> None:
        fs, path = self._fs(f"pointers/{after + 1:012d}")
        try:
            stream = fs.create(path, False)
        except Exception as e:
            raise Conflict(f"{self.root} was changed by another writer") from e
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    def _clean(self) -> None:
        """Drops old pointers, and the versions that only they name. A version without pointer may still be being written."""
        numbers = self._pointers()
        kept = {(self._pointer(n) or {}).get("version") for n in numbers[-KEEP:]}
        for n in numbers[:-KEEP]:
            version = (self._pointer(n) or {}).get("version")
            for name in ([version] if version and version not in kept else []) + [f"pointers/{n:012d}"]:
                fs, path = self._fs(name)
                fs.delete(path, True)

    def reset(self) -> None:
        """Forgets the table and its meta, as a full rebuild asks for."""
        self._commit(self._current()[0], {})
