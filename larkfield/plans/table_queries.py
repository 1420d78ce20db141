"""Snapshot, set and vector queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkfield.operators import cells, metrics, snapshot, vectors
from larkfield.operators.postings import shared_folder
from larkfield.plans.text_queries import table


def _disk(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("doc_id % 10 <> 9")
    return rows.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("size"), (F.col("doc_id") * 3).alias("mtime"))


def _snapshot(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("doc_id % 4 <> 3")
    return rows.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 3).alias("mtime"), (F.col("doc_id") % 5 != 0).alias("symbols_done"))


def backlog_diff(spark, sf_dir):
    return snapshot.backlog(_disk(spark, sf_dir), _snapshot(spark, sf_dir)).select("path", "change")


def priority_work_list(spark, sf_dir):
    changes = snapshot.backlog(_disk(spark, sf_dir), _snapshot(spark, sf_dir))
    asked = table(spark, sf_dir, "documents").where("doc_id % 50 = 1").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    return snapshot.work_list(changes, asked)


def upsert_snapshot(spark, sf_dir):
    new = _disk(spark, sf_dir).withColumn("symbols_done", F.lit(False))
    return snapshot.upsert(_snapshot(spark, sf_dir), new, "path")


def replace_children(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    new = items.where("src % 3 = 0").withColumn("dst", F.col("dst") % 10)
    return snapshot.replace_children(items, new, "src", ["src", "dst", "kind"]).groupBy("src").agg(F.count("*").alias("n"), F.sum("dst").alias("total"))


def cascade_delete(spark, sf_dir):
    live = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey")
    sup = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    rows = snapshot.cascade(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), live, ("l_partkey", "p_partkey"))
    return snapshot.cascade(rows, sup, ("l_suppkey", "s_suppkey"))


def insert_or_ignore(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    old = orders.where("o_orderkey % 100 = 0").groupBy("o_custkey").agg(F.min_by(F.struct("o_custkey", "o_orderkey", "o_totalprice"), "o_orderkey").alias("r")).select("r.*")
    return snapshot.insert_or_ignore(old, orders.where("o_orderkey % 100 <> 0"), "o_custkey", "o_orderkey")


def deleted_files(spark, sf_dir):
    return snapshot.deleted(_disk(spark, sf_dir), _snapshot(spark, sf_dir)).select("path", "size")


def coverage_ratio(spark, sf_dir):
    return metrics.coverage(_snapshot(spark, sf_dir)).select("total", "indexed", F.round("ratio", 6).alias("ratio"))


def union_dedup(spark, sf_dir):
    return _disk(spark, sf_dir).select("path").union(_snapshot(spark, sf_dir).select("path")).distinct()


def symbol_lookup_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    names = [f"nation_{i}" for i in (1, 7, 19, 40)]
    hits = nations.where(F.lower("n_name").isin(names))
    return table(spark, sf_dir, "customer").join(F.broadcast(hits), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


def hash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.top_k(rows, asked, 5).select("query_id", "id", F.round("score", 5).alias("score"))


def vector_cells(spark, sf_dir):
    """``vector_topk`` through cells: those that cannot reach the fifth score are not read."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = cells.CellIndex(spark, f"{shared_folder(spark)}/larkfield-{spark.sparkContext.applicationId}/cells-{uuid.uuid4().hex}")
    index.build(rows)
    return index.top_k(asked, 5).select("query_id", "id", F.round("score", 5).alias("score"))


QUERIES = {f.__name__: f for f in (
    backlog_diff, priority_work_list, upsert_snapshot, replace_children, cascade_delete, insert_or_ignore, deleted_files, coverage_ratio,
    union_dedup, symbol_lookup_join, hash_dedup, vector_topk, vector_cells,
)}

_BOTH = """WITH disk AS (SELECT concat('d/', doc_id) AS path, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, doc_id * 3 AS mtime FROM documents WHERE doc_id % 10 <> 9),
snap AS (SELECT concat('d/', doc_id) AS path, n_chars AS size, doc_id * 3 AS mtime, doc_id % 5 <> 0 AS symbols_done FROM documents WHERE doc_id % 4 <> 3),
ch AS (SELECT disk.path, CASE WHEN snap.path IS NULL THEN 'new' WHEN disk.size <> snap.size OR disk.mtime <> snap.mtime THEN 'changed'
    WHEN NOT symbols_done THEN 'unfinished' ELSE 'unchanged' END AS change FROM disk LEFT JOIN snap USING (path))
"""

SQL = {
    "backlog_diff": _BOTH + "SELECT path, change FROM ch",
    "priority_work_list": _BOTH + """, p AS (SELECT concat('d/', doc_id) AS path FROM documents WHERE doc_id % 50 = 1)
        SELECT path, 0 AS turn FROM p UNION ALL SELECT path, 1 FROM ch WHERE change <> 'unchanged' AND path NOT IN (SELECT path FROM p)""",
    "upsert_snapshot": _BOTH + "SELECT path, size, mtime, false AS symbols_done FROM disk UNION ALL SELECT path, size, mtime, symbols_done FROM snap WHERE path NOT IN (SELECT path FROM disk)",
    "replace_children": """SELECT src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS total FROM (SELECT l_orderkey AS src, l_suppkey AS dst, l_returnflag AS kind FROM lineitem WHERE l_orderkey % 3 <> 0
        UNION ALL (SELECT DISTINCT l_orderkey, l_suppkey % 10, l_returnflag FROM lineitem WHERE l_orderkey % 3 = 0)) GROUP BY 1""",
    "cascade_delete": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)
        AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
    "insert_or_ignore": """WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderkey % 100 <> 0 AS later FROM orders)
        SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY later, o_orderkey) AS r FROM x) WHERE r = 1""",
    "deleted_files": _BOTH + "SELECT path, size FROM snap WHERE path NOT IN (SELECT path FROM disk)",
    "coverage_ratio": _BOTH + "SELECT count(*) AS total, count(*) FILTER (symbols_done) AS indexed, round(count(*) FILTER (symbols_done) / count(*), 6) AS ratio FROM snap",
    "union_dedup": _BOTH + "SELECT path FROM disk UNION SELECT path FROM snap",
    "symbol_lookup_join": "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) IN ('nation_1', 'nation_7', 'nation_19', 'nation_40')",
    "hash_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
    "vector_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS score
        FROM e a, e b WHERE a.vec_id % 20 = 0)
        SELECT query_id, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""",
}
SQL["vector_cells"] = SQL["vector_topk"]
