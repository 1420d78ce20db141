"""Graph queries over the driver's orders: an order is a commit, its parts are the files, suppliers refer to parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.config import Config
from larkfield.functions import ranking
from larkfield.operators import graph
from larkfield.operators.postings import shared_folder
from larkfield.plans.index_loop import KeptIndex

YEAR = 365 * 86_400
NOW, MAX_FILES = 996_624_000, graph.MAX_FILES  # 2001-08-01 00:00:00 UTC; larger orders are left out of pairs


def commits(spark, sf_dir) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    parts = graph.tasks(items)
    files = items.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("files"))
    orders = orders.repartition(parts, "o_orderkey")
    return files.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("sha"), "ts", "files")


def edges(spark, sf_dir) -> DataFrame:
    parts = graph.tasks(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return graph.cochange(commits(spark, sf_dir), NOW, 3_650, MAX_FILES, parts=parts)


def refs(spark, sf_dir) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_quantity") > 5, "ruby_const").otherwise("import").alias("kind")).distinct()


def cochange_pairs(spark, sf_dir):
    return edges(spark, sf_dir).select("file_a", "file_b", F.round("weight", 6).alias("weight"))


def cochange_kept(spark, sf_dir):
    """Co-change by a kept index that takes the orders year by year: earlier weights decay, new ones are added."""
    folder = f"{shared_folder(spark)}/larkfield-{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    kept = KeptIndex(spark, folder, Config(cochange_window_days=3_650))
    made = commits(spark, sf_dir).select(F.col("sha").cast("string").alias("sha"), "ts", F.transform("files", lambda f: f.cast("string")).alias("files"))
    # Made once for all passes, a folder for each year.
    age = F.least(F.lit(6), F.floor((F.lit(NOW) - F.col("ts")) / F.lit(YEAR))).cast("int")
    made.withColumn("age", age).write.partitionBy("age").parquet(f"{folder}/orders")
    orders = spark.read.schema(made.withColumn("age", age).schema).parquet(f"{folder}/orders")
    for year in range(6, -1, -1):  # what is older than all of them comes first
        until, since = NOW - year * YEAR, None if year == 6 else NOW - (year + 1) * YEAR
        mine = orders.where(F.col("age") == year).drop("age")
        kept.add_commits(mine.where(F.col("ts") <= until if since is None else F.col("ts").between(since + 1, until)), until)
    pairs = kept.cochange(NOW).select(*[F.col(c).cast("long").alias(c) for c in ("file_a", "file_b")], "weight")
    return graph.normalise_edges(pairs).withColumn("weight", F.round("weight", 6))


def cochange_topk_neighbors(spark, sf_dir):
    rounded = edges(spark, sf_dir).withColumn("weight", F.round("weight", 6))
    return graph.neighbours(rounded)


def recency_counts(spark, sf_dir):
    return graph.recency(commits(spark, sf_dir), NOW)


def recency_boost(spark, sf_dir):
    seen = graph.recency(commits(spark, sf_dir), NOW)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").join(seen, F.col("p_partkey") == F.col("file"), "left")
    boost = ranking.recency_boost(F.col("commits_30d"), F.col("last_commit_at"), NOW)
    return parts.select("p_partkey", F.round(boost, 6).alias("boost"))


def fan_in_cap(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    share = F.col("n_sources") / F.lit(n)
    return graph.fan_in(refs(spark, sf_dir)).select("dst", "n_sources", (share > ranking.HUB_SHARE).alias("is_hub"))


def referrers_topk(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    return graph.referrers(refs(spark, sf_dir), n, hub_share=0.26)


def edge_replace(spark, sf_dir):
    """K5: edges under a normal key, where the last weight replaces the others."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("file_a"), F.col("l_suppkey").alias("file_b"), "l_orderkey", "l_linenumber", "l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_quantity")
    return graph.normalise_edges(items).groupBy("file_a", "file_b").agg(F.max_by("l_quantity", key).alias("weight"))


def constant_references(spark, sf_dir):
    """References by constant name, resolved over path suffixes: customer names against generated paths."""
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    files = names.select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("app/models/nation_"), (F.col("s_nationkey") % 25).cast("string"), F.lit("/item_"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".rb")).alias("path"))
    hint = F.concat(F.lit("Nation_"), (F.col("s_suppkey") % 25).cast("string"), F.lit("::Item_"), (F.col("s_suppkey") % 5).cast("string"))
    imports = names.select((F.col("s_suppkey") + 1_000_000).alias("file_id"), F.lit("lib/x.rb").alias("path"), hint.alias("hint"), F.lit("ruby_const").alias("kind"))
    return graph.resolve_references(imports, files).select("src", "dst", "kind")


def import_references(spark, sf_dir):
    """References by relative and by bare imports: customers are files of five folders that import one another."""
    key = F.col("c_custkey")
    tail = F.element_at(F.lit([".ts", ".py", ".rb", "/index.js"]), (key % 4 + 1).cast("int"))
    name = lambda k: F.concat(F.lit("f"), k.cast("string"))
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("file_id"), F.concat(F.lit("src/p"), (key % 5).cast("string"), F.lit("/"), name(key), tail).alias("path"))
    k = F.col("file_id")
    # A file below a folder of its own is one level deeper.
    up = F.when(k % 4 == 3, "../").otherwise("")
    hint = (
        F.when(k % 3 == 0, F.concat(F.lit("./"), up, F.lit("../p"), ((k + 1) % 5).cast("string"), F.lit("/"), name(k + 1)))
        .when(k % 3 == 1, F.concat(F.lit("./"), up, name(k + 5))).otherwise(F.concat(F.lit("lib/x/"), name(k % 40)))
    )
    imports = files.select("file_id", "path", hint.alias("hint"), F.when(k % 2 == 0, "import").otherwise("require").alias("kind"))
    return graph.resolve_references(imports, files).select("src", "dst", "kind")


QUERIES = {f.__name__: f for f in (
    cochange_pairs, cochange_kept, cochange_topk_neighbors, recency_counts, recency_boost, fan_in_cap, referrers_topk, edge_replace, constant_references,
    import_references,
)}

_COMMITS = f"""
WITH cm AS (SELECT o_orderkey AS sha, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders),
f AS (SELECT sha, ts, l_partkey AS file, row_number() OVER (PARTITION BY sha) AS i, count(*) OVER (PARTITION BY sha) AS n FROM cm JOIN lineitem ON l_orderkey = sha),
p AS (SELECT least(a.file, b.file) AS file_a, greatest(a.file, b.file) AS file_b, sum(exp(-greatest(0, ({NOW} - a.ts) / 86400.0) / 3650.0)) AS weight
    FROM f a JOIN f b ON a.sha = b.sha AND a.i < b.i AND a.file <> b.file WHERE a.n <= {MAX_FILES} GROUP BY 1, 2)
"""
_RECENCY = f"""SELECT file, greatest(0, max(ts)) AS last_commit_at, count(*) FILTER (greatest(0, ({NOW} - ts) / 86400.0) <= 30) AS commits_30d,
    count(*) FILTER (greatest(0, ({NOW} - ts) / 86400.0) <= 90) AS commits_90d FROM f GROUP BY 1"""
_REFS = "WITH r AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_quantity > 5 THEN 'ruby_const' ELSE 'import' END AS kind FROM lineitem)"

SQL = {
    "cochange_pairs": _COMMITS + "SELECT file_a, file_b, round(weight, 6) AS weight FROM p",
    "cochange_kept": _COMMITS + "SELECT file_a, file_b, round(weight, 6) AS weight FROM p",
    "cochange_topk_neighbors": _COMMITS + """, u AS (SELECT file_a AS file, file_b AS other, round(weight, 6) AS weight FROM p
        UNION ALL SELECT file_b, file_a, round(weight, 6) FROM p)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY weight DESC, other) AS rank FROM u) WHERE rank <= 5""",
    "recency_counts": _COMMITS + _RECENCY,
    "recency_boost": _COMMITS + f""", s AS ({_RECENCY}) SELECT p_partkey, round((least(coalesce(commits_30d, 0), 10) / 10.0
        + CASE WHEN last_commit_at IS NULL THEN 0 ELSE exp(-greatest(0, ({NOW} - last_commit_at) / 86400.0) / 90.0) END) / 2.0, 6) AS boost FROM part LEFT JOIN s ON file = p_partkey""",
    "fan_in_cap": _REFS + """ SELECT dst, count(DISTINCT src) AS n_sources, count(DISTINCT src) / (SELECT count(*) FROM part) > 0.2 AS is_hub
        FROM r WHERE kind = 'ruby_const' GROUP BY 1""",
    "referrers_topk": _REFS + """, h AS (SELECT dst FROM r WHERE kind = 'ruby_const' GROUP BY 1 HAVING count(DISTINCT src) / (SELECT count(*) FROM part) > 0.26)
        SELECT * FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS rank FROM (SELECT DISTINCT dst, src FROM r
        WHERE dst NOT IN (SELECT dst FROM h))) WHERE rank <= 10""",
    "edge_replace": """SELECT least(l_partkey, l_suppkey) AS file_a, greatest(l_partkey, l_suppkey) AS file_b,
        arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS weight FROM lineitem GROUP BY 1, 2""",
    "import_references": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'import' ELSE 'require' END AS kind FROM customer),
        e AS (SELECT k AS src, CASE k % 3 WHEN 0 THEN k + 1 WHEN 1 THEN k + 5 ELSE k % 40 END AS dst, kind, k % 3 = 2 AS bare FROM c)
        SELECT DISTINCT src, dst, e.kind FROM e JOIN c ON c.k = dst WHERE src <> dst AND NOT (bare AND dst % 4 = 3)""",
    "constant_references": """WITH f AS (SELECT s_suppkey AS dst, concat('app/models/nation_', s_nationkey % 25, '/item_', s_suppkey % 7, '.rb') AS path FROM supplier),
        c AS (SELECT s_suppkey + 1000000 AS src, concat('nation_', s_suppkey % 25, '/item_', s_suppkey % 5, '.rb') AS tail FROM supplier)
        SELECT DISTINCT src, dst, 'ruby_const' AS kind FROM c JOIN f ON path = tail OR ends_with(path, concat('/', tail)) WHERE src <> dst""",
}
