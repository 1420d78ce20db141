"""URL filters: host rules first, then gradient-boosted trees on lexical features; DataFrame and SQL only.

The trees are fitted by Spark ML on labelled URLs (a bounded set; by default ``labelled_urls``) and compiled to SQL CASE
expressions, so that all URLs are judged inside one generated stage that reads the url column alone. No table labels
URLs, so the default labels come from generators of shapes that are known for ordinary sites and for abuse (random
hosts, keyword chains, numeric hosts, affiliate links, throw-away suffixes, deep forged paths); words are made of
syllables, so that no list of words decides. Suffix statistics are the log odds of the labels by suffix.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees
on what remains; URLs of any length are read whole; of rules of equal length that fit, the first in order of the text
decides; repeated rows are judged alike; an empty table stays empty; input columns of the names written (host, path,
rule, risk, verdict) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.llm.common import without

#: (rule, verdict): a host and all its subdomains, with the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: At most so many rules become one CASE expression; longer lists belong in a joined table.
MAX_RULES = 500
#: At most so many labelled URLs are used for fitting.
MAX_LABELLED = 50_000
FEATURES = (
    "url_length", "host_length", "host_depth", "path_depth", "path_length", "digit_ratio", "host_digits", "hyphens", "host_entropy",
    "parameters", "specials", "longest_label", "suffix_odds", "vowel_ratio", "consonants", "numeric_host", "longest_mixed", "query_length",
)
#: Suffixes of the generated URLs, by how ordinary they are, and parts of paths and parameters.
COMMON, CHEAP = "com com com org net de fr es edu gov co.uk io".split(), "biz info top xyz click loan win ru cn pw tk icu".split()
SECTIONS, ENDINGS = "en de fr es news blog about docs products category article wiki".split(), ["", "", "/", ".html", ".htm", "/index.html"]
PLAIN_PARAMETERS, PAID_PARAMETERS = "page id q lang ref utm_source sort".split(), "aff_id subid clickid cid offer tid src campaign pub redirect".split()
FORGED = "wp-admin/js wp-content/uploads cgi-bin/secure account/verify login/update webscr/confirm images/tmp".split()
SYLLABLES = "ba be bi bo da de di do fa fe ga go ha he ja ka ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa we ya zo an en in on er ar or al el st sch tadt berg ing tion cht str ck ght bib ment land heim worth ville".split()


def labelled_urls(spark: SparkSession, n: int = 12_000, seed: int = 0) -> DataFrame:
    """(url, label): seeded URLs of ordinary sites and, with label 1, of abusive ones; one in fifty labels is wrong."""

    def number(below: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(below))

    def pick(values, salt: int) -> Column:
        return F.element_at(F.lit(list(values)), (number(len(values), salt) + 1).cast("int"))

    def word(salt: int) -> Column:
        more = number(8, salt + 2)
        tail = F.when(more < 4, pick(SYLLABLES, salt + 3)).when(more == 4, F.concat(pick(SYLLABLES, salt + 3), pick(SYLLABLES, salt + 200))).when(more == 5, F.concat(pick(SYLLABLES, salt + 3), pick(SYLLABLES, salt + 200), pick(SYLLABLES, salt + 400))).otherwise("")
        return F.concat(pick(SYLLABLES, salt), pick(SYLLABLES, salt + 1), tail)

    def letters(salt: int, least: int, more: int) -> Column:
        return F.translate(F.substr(F.hex(F.xxhash64("id", F.lit(salt), F.lit(seed))), F.lit(1), (number(more, salt + 1) + least).cast("int")), "0123456789ABCDEF", "qzxk4jw7vtrhpgmb")

    plain_host = F.concat(pick(["", "", "www.", "blog.", "m.", "shop."], 1), word(2), F.when(number(2, 6) == 0, F.concat(F.when(number(2, 7) == 0, "-").otherwise(""), word(8))).otherwise(""), F.lit("."), pick(COMMON, 12))
    slug = F.concat_ws("-", word(14), F.when(number(2, 18) == 0, word(19)), F.when(number(3, 23) == 0, word(24)))
    plain_path = F.concat(F.lit("/"), F.when(number(4, 30) < 3, F.concat(pick(SECTIONS, 31), F.lit("/"))).otherwise(""), F.when(number(3, 32) == 0, number(3000, 33).cast("string")).otherwise(slug), pick(ENDINGS, 34))
    plain_tail = F.when(number(4, 35) == 0, F.concat(F.lit("?"), pick(PLAIN_PARAMETERS, 36), F.lit("="), F.when(number(2, 37) == 0, number(500, 38).cast("string")).otherwise(word(39)))).when(number(8, 43) == 0, "#top").otherwise("")
    plain = F.concat(plain_host, F.when(number(8, 44) == 0, "/").otherwise(F.concat(plain_path, plain_tail)))
    some_suffix = F.when(number(10, 50) < 6, pick(CHEAP, 51)).otherwise(pick(COMMON, 52))
    chain = F.concat_ws("-", word(60), word(64), word(68), F.when(number(2, 72) == 0, word(73)))
    paid = F.concat(F.lit("?"), pick(PAID_PARAMETERS, 80), F.lit("="), F.hex(F.xxhash64("id", F.lit(81))), F.lit("&"), pick(PAID_PARAMETERS, 82), F.lit("="), number(10**6, 83).cast("string"), F.lit("&"), pick(PAID_PARAMETERS, 84), F.lit("="), letters(85, 4, 8))
    address = F.concat_ws(".", *[number(254, s).cast("string") for s in (90, 91, 92, 93)])
    forged = F.concat(F.lit("/"), pick(FORGED, 94), F.lit("/"), letters(95, 6, 8), F.lit(".php"))
    deep = F.concat_ws(".", letters(100, 4, 6), word(102), letters(106, 5, 6), word(108))
    kind = number(6, 110)
    risky = (
        F.when(kind == 0, F.concat(letters(111, 8, 8), F.lit("."), some_suffix, F.lit("/"), letters(113, 3, 10)))
        .when(kind == 1, F.concat(chain, F.lit("."), some_suffix, F.lit("/"), F.when(number(2, 115) == 0, chain).otherwise("")))
        .when(kind == 2, F.concat(address, forged))
        .when(kind == 3, F.concat(word(116), F.lit("."), some_suffix, F.lit("/"), letters(120, 2, 5), paid))
        .when(kind == 4, F.concat(deep, F.lit("."), some_suffix, forged))
        .otherwise(F.concat(word(122), number(9999, 126).cast("string"), F.lit("."), pick(CHEAP, 127), plain_path, paid))
    )
    bad = number(2, 130) == 0
    label = F.when(number(50, 131) == 0, ~bad).otherwise(bad).cast("int")
    return spark.range(n).select(F.concat(pick(["http://", "https://"], 132), F.when(bad, risky).otherwise(plain)).alias("url"), label.alias("label"))


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    lower = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} become an expression")
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


@dataclass(frozen=True)
class UrlModel:
    """Trees as a SQL expression of the margin, with the statistics behind the learned feature."""

    margin: str
    suffix_odds: dict[str, float]
    threshold: float = 0.5


def _suffix(host: Column) -> Column:
    """The last label of a host, or the last two where the last has two letters and the one before up to three."""
    return F.regexp_extract(host, "((?:\\.[a-z]{2,3})?\\.[a-z]{2}|[^.]*)$", 1)


def _odds(counted: DataFrame) -> dict[str, float]:
    """Of every suffix of the labelled rows, whose number is bounded."""
    smoothed = F.log((F.col("bad") + 1.0) / (F.col("good") + 1.0))
    return {r.key: float(r.odds) for r in counted.select("key", smoothed.alias("odds")).orderBy("key").collect()}


def _split(df: DataFrame) -> DataFrame:
    host, path = split_url(F.coalesce(F.col("url"), F.lit("")))
    return df.withColumn("__h", host).withColumn("__p", path)


def add_features(df: DataFrame, suffix_odds: dict[str, float]) -> DataFrame:
    """The feature columns (doubles) of a frame with columns url, __h (host) and __p (path)."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("__h"), F.col("__p")
    length = F.greatest(F.length(host), F.lit(1))

    def share(acc: Column, c: Column) -> Column:
        p = (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / length
        return acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    def longest(text: Column, pattern: str) -> Column:
        return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)), F.lit(0))

    alphabet = F.lit(list("abcdefghijklmnopqrstuvwxyz0123456789-."))
    known = F.create_map(*[F.lit(x) for kv in suffix_odds.items() for x in kv]) if suffix_odds else F.lit(None).cast("map<string,double>")
    made = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "host_depth": F.regexp_count(host, F.lit("\\.")),
        "path_depth": F.regexp_count(path, F.lit("/")),
        "path_length": F.length(path),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
        "host_digits": F.regexp_count(host, F.lit("[0-9]")),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "host_entropy": F.aggregate(alphabet, F.lit(0.0), share),
        "parameters": F.regexp_count(url, F.lit("[?&][^=&#]*=")),
        "specials": F.regexp_count(url, F.lit("[^a-zA-Z0-9/:.]")),
        "longest_label": longest(host, "[^.]+"),
        "suffix_odds": F.coalesce(F.try_element_at(known, _suffix(host)), F.lit(0.0)),
        "vowel_ratio": F.regexp_count(host, F.lit("[aeiou]")) / length,
        "consonants": longest(host, "[bcdfghjklmnpqrstvwxz]+"),
        "numeric_host": host.rlike("^[0-9.]+$").cast("int"),
        "longest_mixed": longest(url, "[A-Za-z]*[0-9][A-Za-z0-9]*"),
        "query_length": F.length(F.regexp_extract(url, "[?]([^#]*)", 1)),
    }
    return df.withColumns({f"__f_{k}": made[k].cast("double") for k in FEATURES})


def fit_urls(labelled: DataFrame, rounds: int = 30, depth: int = 4, threshold: float = 0.5) -> UrlModel:
    """Fits on (url, label) rows, at most ``MAX_LABELLED`` of them (those of least hash)."""
    return fit_trees(labelled, rounds, depth, threshold)[0]


def fit_trees(labelled: DataFrame, rounds: int = 30, depth: int = 4, threshold: float = 0.5) -> tuple[UrlModel, GBTClassificationModel]:
    """The compiled model and Spark ML's own."""
    data = _split(labelled.select("url", "label").orderBy(F.xxhash64("url", "label"), "url").limit(MAX_LABELLED)).cache()
    try:
        votes = F.sum(F.col("label").cast("double")).alias("bad"), F.sum(1.0 - F.col("label")).alias("good")
        odds = _odds(data.groupBy(_suffix(F.col("__h")).alias("key")).agg(*votes))
        trees = GBTClassifier(featuresCol="__v", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1).fit(vectors(data, odds))
    finally:
        data.unpersist()
    terms = [f"{float(w)!r}D * ({_case(t._java_obj.rootNode())})" for t, w in zip(trees.trees, trees.treeWeights)]
    return UrlModel(" + ".join(terms), odds, threshold), trees


def vectors(split: DataFrame, odds: dict[str, float]) -> DataFrame:
    return VectorAssembler(inputCols=[f"__f_{k}" for k in FEATURES], outputCol="__v").transform(add_features(split, odds))


def _case(node) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return (
        f"CASE WHEN __f_{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r}D"
        f" THEN {_case(node.leftChild())} ELSE {_case(node.rightChild())} END"
    )


def judge_urls(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, risk (0 to 1, of the trees) and verdict (allow or block)."""
    pages = without(pages, ["host", "path", "rule", "risk", "verdict"])
    df = add_features(_split(pages if url == "url" else pages.withColumn("url", F.col(url))), model.suffix_odds)
    risk = 1.0 / (1.0 + F.exp(-2.0 * F.expr(model.margin)))
    rule, says = rule_columns(F.col("__h"), F.col("__p"), rules)
    method = F.when(F.col("risk") >= model.threshold, "block").otherwise("allow")
    return df.withColumn("risk", risk).select(
        *[F.col(f"`{c}`") for c in pages.columns], F.col("__h").alias("host"), F.col("__p").alias("path"),
        rule.alias("rule"), "risk", F.coalesce(says, method).alias("verdict"),
    )
