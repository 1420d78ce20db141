import sqlite3

import pytest
from pyspark.sql import functions as F

from larkfield.functions import classify, ranking, text
from larkfield.functions.stem import porter


def value(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("name", "parts"),
    [("createUser", ["create", "user"]), ("power_flow", ["power", "flow"]), ("HTTPServer", ["http", "server"]), ("a.b-C2D", ["a", "b", "c2", "d"]), ("", [])],
)
def test_split_identifier(spark, name, parts):
    assert value(spark, text.split_identifier(F.col("x")), x=name) == parts


def test_keywords_drop_junk_and_keep_first_use(spark):
    raw = F.lit(["123", "deadbeef0123", "https://x.com/y", "value", "decade", "the", "gridSync", "value"])
    assert value(spark, text.keywords(raw, text.stoplist("ruby"))) == ["value", "grid", "sync"]
    assert value(spark, text.keywords(raw, text.stoplist("ruby", ["GRID"]))) == ["value", "sync"]


def test_prose_tokens(spark):
    assert value(spark, text.prose_tokens(F.col("x"), text.stoplist("prose")), x="See https://a.b/c The Grid_Sync grid_sync café") == ["see", "grid_sync", "caf"]


def test_underscore_constant(spark):
    assert value(spark, text.underscore_constant(F.col("x")), x="HTTPServer::OrdersController") == "http_server/orders_controller"


def test_index_terms_fold_marks(spark):
    assert value(spark, text.index_terms(F.col("x")), x="Élan grid-sync 42") == ["elan", "grid", "sync", "42"]


def test_porter_agrees_with_sqlite():
    words = (
        "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing failing happy sky relational "
        "conditional rational digitizer operator feudalism decisiveness hopefulness formality triplicate formative electrical goodness revival allowance "
        "inference adjustable replacement adoption activate effective rate cease controlling rolled calculate calculation migrate migration dying yes"
    ).split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter')")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(words)))
    stems = dict(db.execute("select doc, term from v"))
    assert [porter(w) for w in words] == [stems[i] for i in range(len(words))]


@pytest.mark.parametrize(
    ("query", "kind"), [("", "open-ended"), ("grid", "identifier"), ("a.b", "identifier"), ("42x", "open-ended"), ("a b", "keyword"), ("a b c d", "open-ended")]
)
def test_query_type(spark, query, kind):
    assert value(spark, classify.query_type(F.col("x")), x=query) == kind


@pytest.mark.parametrize(
    ("prompt", "kind"),
    [
        ("", "skip_nudge"), ("open src/app.ts please", "skip_nudge"), ("look at README.md", "skip_nudge"), ("what branch am i on", "skip_nudge"),
        ("read the pr comments", "skip_nudge"), ("fix the pr comments", "likely_orientation"), ("see https://x.y", "skip_nudge"),
        ("investigate https://x.y", "likely_orientation"), ("how does login work", "likely_orientation"),
    ],
)
def test_prompt_class(spark, prompt, kind):
    assert value(spark, classify.prompt_class(F.col("x")), x=prompt) == kind


@pytest.mark.parametrize(
    ("command", "found"),
    [
        ("cd x && rg foo", ("rg", "foo")), ("ls | grep a | head", None), ("rg widget; echo done", ("rg", "widget")), ("find . -iname '*.py'", ("find", "*.py")),
        ("git grep -n 'a b'", ("git-grep", "a b")), ("egrep x", ("grep", "x")), ("echo 'rg foo'", None), ("fdfind n", ("fd", "n")), (None, None), ("find .", None),
    ],
)
def test_detect_search(command, found):
    assert classify.detect_search(command) == found


@pytest.mark.parametrize(
    ("command", "found"),
    [
        ("grep -rn foo src", (True, "symbol")), ("grep -r 'a.b'", (True, "regex")), ("grep foo a.txt", (False, None)), ("git grep foo src", (False, None)),
        ("echo $(grep -R foo)", (True, "symbol")), ("x=`grep -r foo`", (True, "symbol")), ("grep foo a.txt; ls -R", (False, None)),
        ("grep -e foo src", (True, "symbol")), ("grep --help -r x", (False, None)),
    ],
)
def test_classify_grep(command, found):
    assert classify.classify_grep(command, lambda p: p == "src") == found


def test_guidance(spark):
    assert value(spark, classify.guidance_tier(F.lit(9), F.lit(10), F.lit(True))) == "strong"
    assert value(spark, classify.guidance_tier(F.lit(0), F.lit(0), F.lit(True))) == "weak"
    assert value(spark, classify.guidance_caveats(F.lit(0), F.lit(False), F.lit("a"), F.lit("b"))) == ["booting", "lagging"]


def test_signals(spark):
    path = F.lit("app/models/grid.rb")
    assert [value(spark, ranking.path_match(F.lit([t]), path)) for t in ("grid", "model", "zzz")] == [1.0, 0.5, 0.0]
    assert value(spark, ranking.recency_boost(F.lit(None).cast("int"), F.lit(None).cast("long"), 0)) == 0.0
    assert value(spark, ranking.recency_boost(F.lit(20), F.lit(100), 100)) == 1.0
    for p, test in {"spec/a.rb": True, "a/tests/b.py": True, "x_spec.rb": True, "a.test.tsx": True, "test_x.py": True, "latest/x.py": False}.items():
        assert value(spark, ranking.is_test_path(F.lit(p))) is test


def test_confidence(spark):
    def of(*flags):
        return value(spark, ranking.confidence(*[F.lit(f) for f in flags]))

    assert of(True, True, 3, False) == "high"
    assert of(False, True, 2, True) == "low"
    assert of(False, True, 1, True) == "high"
    assert of(False, False, 1, False) == "low"
