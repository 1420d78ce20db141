"""Files as a table: enumeration, secrets, ignored folders, languages, size and binary gates."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is never indexed, and the language of each extension.
SECRET_PREFIXES = (".env", "id_")
SECRET_SUFFIXES = (".pem", ".key", ".p12", ".pfx")
IGNORED = ("node_modules", ".git", "dist", "build", "vendor", ".next", "target", "__pycache__", ".venv", "coverage")
LANGUAGES = {
    "ruby": ("rb",), "python": ("py",), "ts": ("ts", "tsx", "mts", "cts"), "js": ("js", "jsx", "mjs", "cjs"),
    "prose": ("md", "markdown", "txt", "rst", "adoc"),
}
MAX_BYTES, PROBE_BYTES, HEAD_BYTES = 1_048_576, 8_000, 4_096
#: Bytes of content in a batch.
BATCH_BYTES = 16_000_000


def is_secret(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    tests = [name.startswith(p) for p in SECRET_PREFIXES] + [name.endswith(s) for s in SECRET_SUFFIXES]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def has_ignored_segment(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.lit(list(IGNORED)))


def language(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for lang, names in LANGUAGES.items():
        out = F.when(extension.isin(*names), lang).otherwise(out)
    return out


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 8000."""
    return F.contains(F.substring(content, 1, PROBE_BYTES), F.unhex(F.lit("00")))


def _contents(max_bytes: int):
    """Adds ``content``: files of up to ``max_bytes`` whole, of larger ones the first ``PROBE_BYTES``."""

    def read(uri: str, length: int) -> bytes:
        system, path = pafs.FileSystem.from_uri(uri)
        with system.open_input_stream(path) as f:
            return f.read(length if length <= max_bytes else PROBE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, found = 0, 0, []
            for k, (uri, length) in enumerate(zip(batch.column("uri").to_pylist(), batch.column("length").to_pylist())):
                found.append(read(uri, length))
                size += len(found[-1])
                if size > BATCH_BYTES or k == batch.num_rows - 1:  # small batches, as files may be large
                    part = batch.slice(first, len(found))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "content"])
                    first, size, found = k + 1, 0, []

    return run


def list_tree(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """(path, uri, length, modificationTime) of the files below a folder, or of those in paths(path), none of them opened;
    without secrets and ignored folders."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    local = F.regexp_replace(F.regexp_replace("uri", "^[a-z0-9+.-]+:/+", "/"), "^/+", "/")
    listed = scan.load(root).select(F.col("path").alias("uri"), "length", "modificationTime").withColumn("path", F.substr(local, F.lit(len(base) + 2)))
    listed = listed.where(~is_secret(F.col("path")) & ~has_ignored_segment(F.col("path")))
    if paths is not None:
        listed = listed.join(paths.select("path").distinct(), "path", "left_semi")
    return listed.select("path", "uri", "length", "modificationTime")


def read_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, paths: DataFrame | None = None) -> DataFrame:
    """(path, lang, size, mtime, content_hash, text, indexable) of the files below a folder, or of those in paths(path).

    Files are listed first, without their content: secrets, ignored folders and files that are not asked for are never
    opened. Those that passed are read by the tasks that hold their names. Too large and binary files keep a row with the
    hash of their first 4096 bytes, no language and no text; of too large ones no more than their first bytes are read.
    """
    listed = list_tree(spark, root, paths)
    schema = T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType())])
    rows = listed.mapInArrow(_contents(max_bytes), schema)
    gated = (F.col("length") > max_bytes) | is_binary(F.col("content"))
    lang = language(F.col("path"))
    return rows.select(
        "path", F.when(~gated, lang).alias("lang"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"),
        F.sha2(F.when(gated, F.substring("content", 1, HEAD_BYTES)).otherwise(F.col("content")), 256).alias("content_hash"),
        F.when(~gated & lang.isNotNull(), F.decode("content", "UTF-8")).alias("text"), (~gated).alias("indexable"),
    )


def relative_path(root: str, path: str, cwd: str | None = None) -> str | None:
    """POSIX path below ``root``; None if it leads out."""
    full = os.path.normpath(os.path.join(cwd or root, path))
    out = PurePosixPath(os.path.relpath(full, root)).as_posix()
    return None if out == ".." or out.startswith("../") else out
