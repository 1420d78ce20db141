"""Graphs over files: co-change with time decay, reference resolution, fan-in, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkfield.functions.ranking import DAY, HUB_SHARE, NEIGHBOURS, REFERRERS, stem_of
from larkfield.functions.text import underscore_constant

MAX_FILES, WINDOW_DAYS = 50, 180
#: Extensions tried for an import, in this order.
EXTENSIONS = (".rb", ".py", ".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs")

#: Rows that one task groups.
TASK_ROWS = 500_000


def tasks(df: DataFrame) -> int:
    """Tasks for a grouping of the rows of a stored table. Spark sizes its own by bytes before they are unfolded, so that
    what a task holds grows with the input."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def age_days(ts: Column, now: int) -> Column:
    """Days since ``ts`` (seconds); a future time counts as now."""
    return F.greatest(F.lit(0.0), (F.lit(now) - ts) / F.lit(float(DAY)))


def recency(commits: DataFrame, now: int) -> DataFrame:
    """(file, last_commit_at, commits_30d, commits_90d) from commits(sha, ts, files); repeats in a commit count."""
    rows = commits.select("ts", F.explode("files").alias("file"))
    age = age_days(F.col("ts"), now)
    return rows.groupBy("file").agg(
        F.greatest(F.lit(0), F.max("ts")).alias("last_commit_at"), F.count_if(age <= 30).alias("commits_30d"), F.count_if(age <= 90).alias("commits_90d")
    )


def cochange(commits: DataFrame, now: int, window_days: int = WINDOW_DAYS, max_files: int = MAX_FILES, self_pairs: bool = False, parts: int | None = None) -> DataFrame:
    """(file_a, file_b, weight) with file_a < file_b: the decayed count of common commits.

    Commits of more than ``max_files`` files are left out before pairs are made, so that a commit yields a bounded
    number of pairs; they are made from its own array, without a self-join. With ``parts`` pairs are dealt to so many tasks
    before they are added up, as few of them come twice in one task of commits.
    """
    small = commits.where(F.size("files") <= max_files)
    weight = F.exp(-age_days(F.col("ts"), now) / F.lit(float(window_days)))
    first = small.select(weight.alias("w"), "files", F.posexplode("files").alias("i", "x"))
    pairs = first.select("w", "x", F.explode(F.expr("slice(files, i + 2, greatest(0, size(files) - i - 1))")).alias("y"))
    edges = pairs.select(F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b"), "w")
    if not self_pairs:
        edges = edges.where("file_a < file_b")
    edges = edges if parts is None else edges.repartition(parts, "file_a", "file_b")
    return edges.groupBy("file_a", "file_b").agg(F.sum("w").alias("weight"))


def cochange_part(commits: DataFrame, asof: int, window_days: int = WINDOW_DAYS, max_files: int = MAX_FILES, parts: int | None = None) -> DataFrame:
    """``cochange`` of one lot of commits as it stands at ``asof``; commits dated later wait (``not_yet``)."""
    return cochange(commits.where(F.col("ts") <= asof), asof, window_days, max_files, parts=parts).withColumn("asof", F.lit(asof).cast("long"))


def not_yet(commits: DataFrame, asof: Column | int) -> DataFrame:
    """Commits dated after ``asof``: their age there is nought, so they cannot be kept under decay until then."""
    return commits.where(F.col("ts") > asof)


def cochange_at(parts: DataFrame, now: int, window_days: int = WINDOW_DAYS, waiting: DataFrame | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """``cochange`` at ``now`` from parts(file_a, file_b, weight, asof) and commits that wait.

    All weights of a part have decayed by the same factor since it was made, so old commits are not read again.
    """
    decayed = F.col("weight") * F.exp(-(F.lit(now) - F.col("asof")) / F.lit(float(DAY)) / F.lit(float(window_days)))
    rows = parts.select("file_a", "file_b", decayed.alias("weight"))
    if waiting is not None:
        rows = rows.unionByName(cochange(waiting, now, window_days, max_files))
    return rows.groupBy("file_a", "file_b").agg(F.sum("weight").alias("weight"))


def normalise_edges(edges: DataFrame, a: str = "file_a", b: str = "file_b") -> DataFrame:
    return edges.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def neighbours(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(file, other, weight, rank): the k heaviest partners of every file, ties by the partner."""
    both = edges.select(F.col("file_a").alias("file"), F.col("file_b").alias("other"), "weight").unionByName(
        edges.select(F.col("file_b").alias("file"), F.col("file_a").alias("other"), "weight")
    )
    order = W.partitionBy("file").orderBy(F.desc("weight"), "other")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fan_in(refs: DataFrame, kind: str | None = "ruby_const") -> DataFrame:
    """(dst, n_sources): distinct files that refer to each file."""
    rows = refs if kind is None else refs.where(F.col("kind") == kind)
    return rows.groupBy("dst").agg(F.count_distinct("src").alias("n_sources"))


def referrers(refs: DataFrame, n_files: int, k: int = REFERRERS, hub_share: float = HUB_SHARE, kind: str | None = "ruby_const") -> DataFrame:
    """(dst, src, rank): the first k distinct referrers; files that too large a share of all refer to have none."""
    hubs = fan_in(refs, kind).where(F.col("n_sources") / F.lit(max(1, n_files)) > hub_share).select("dst")
    rows = refs.select("dst", "src").distinct().join(hubs, "dst", "left_anti")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("dst").orderBy("src"))).where(F.col("rank") <= k)


def cluster(anchors: DataFrame, edges: DataFrame, refs: DataFrame, n_files: int) -> DataFrame:
    """anchors(query_id, file) with arrays cochange and referrers."""
    near = neighbours(edges).join(anchors, "file").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "other"))).alias("c"))
    back = referrers(refs, n_files).join(anchors, F.col("dst") == F.col("file")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "src"))).alias("r"))
    out = anchors.join(near, "query_id", "left").join(back, "query_id", "left")
    return out.select("query_id", "file", F.coalesce("c.other", F.array()).alias("cochange"), F.coalesce("r.src", F.array()).alias("referrers"))


def normal_path(path: Column) -> Column:
    """Removes ``.`` and resolves ``..`` segments."""
    step = lambda acc, s: F.when((s == ".") | (s == ""), acc).when(
        (s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))
    ).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


#: Importers of one constant that meet its files in one task.
IMPORTERS = 4_096


def resolve_references(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind) edges from imports(file_id, path, hint, kind) and files(file_id, path).

    Relative hints try the path itself, then extensions, then index files; the first that exists wins. Constants match
    every path that ends in theirs, by an equi-join on path suffixes. Other hints match the first file of their stem.
    Unresolved hints and self-references give no edge.
    """
    target = files.select(F.col("file_id").alias("dst"), F.col("path").alias("target"))
    rest = imports.where("kind <> 'ruby_const'")
    near = rest.where((F.col("kind") == "require_relative") | F.col("hint").startswith("."))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    base = normal_path(F.concat_ws("/", folder, F.col("hint")))
    # A file stands under every path that comes to it by one of the endings tried, so that hints are not multiplied by them.
    tails = ["", *EXTENSIONS, *[f"/index{e}" for e in EXTENSIONS]]
    tried = [F.when(F.col("target").endswith(t), F.struct(F.lit(i).alias("turn"), F.expr(f"left(target, length(target) - {len(t)})").alias("base"))) for i, t in enumerate(tails)]
    reached = target.select("dst", F.explode(F.array_compact(F.array(*tried))).alias("t")).select("dst", "t.turn", "t.base")
    hits = near.select(F.col("file_id").alias("src"), "kind", "hint", base.alias("base")).join(reached, "base")
    local = hits.groupBy("src", "kind", "hint").agg(F.min(F.struct("turn", "dst")).alias("first")).select("src", "first.dst", "kind")

    bare = rest.where((F.col("kind") != "require_relative") & ~F.col("hint").startswith("."))
    first = target.groupBy(stem_of(F.col("target")).alias("stem")).agg(F.min("dst").alias("dst"))
    stems = bare.select(F.col("file_id").alias("src"), "kind", stem_of(F.col("hint")).alias("stem")).join(first, "stem").select("src", "dst", "kind")
    return _named(imports, target).unionByName(local.unionByName(stems).distinct()).where("src <> dst")


def _tails(path: Column) -> Column:
    """A path, and what is left of it below each of its folders."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _named(imports: DataFrame, target: DataFrame) -> DataFrame:
    """(src, dst, kind) of constants, each once, without comparing the pairs, which may be many more than the rows.

    Of two constants of a file the longer is left out if it ends in the other, as the other names all its paths. Those that
    are left cannot both name a path, so only files of several paths can be met twice.
    """
    suffix = F.concat(underscore_constant(F.col("hint")), F.lit(".rb"))
    constants = imports.where("kind = 'ruby_const'").select(F.col("file_id").alias("src"), "kind", suffix.alias("suffix")).where("suffix is not null").distinct()
    shorter = constants.select("src", "kind", F.col("suffix").alias("whole"), F.explode(_tails(F.col("suffix"))).alias("suffix")).where("suffix <> whole")
    longer = shorter.join(constants, ["src", "kind", "suffix"], "left_semi").select("src", "kind", F.col("whole").alias("suffix"))
    constants = constants.join(longer.distinct(), ["src", "kind", "suffix"], "left_anti")
    sizes = constants.groupBy("suffix").agg(F.ceil(F.count("*") / IMPORTERS).cast("int").alias("parts"))
    by_tail = target.distinct().select("dst", F.explode(_tails(F.col("target"))).alias("suffix"))
    by_tail = by_tail.groupBy("dst", "suffix").agg(F.lit(1).alias("__one")).drop("__one").join(sizes, "suffix")
    several = target.groupBy("dst").agg(F.count_distinct("target").alias("n")).where("n > 1").select("dst", F.lit(True).alias("several"))
    by_tail = by_tail.join(several, "dst", "left").select("dst", "suffix", "several", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # Constants that many files name are dealt to several tasks.
    dealt = constants.join(sizes, "suffix").withColumn("part", F.pmod(F.xxhash64("src"), F.col("parts")).cast("int"))
    once = dealt.join(by_tail.where("several is null"), ["suffix", "part"]).select("src", "dst", "kind")
    again = dealt.join(by_tail.where("several"), ["suffix", "part"]).select("src", "dst", "kind").distinct()
    return once.unionByName(again)
