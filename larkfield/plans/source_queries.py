"""Source queries over the driver's tables: code and commit logs made of their content, and what is read out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.functions import classify, text
from larkfield.operators import events, extract, sessions
from larkfield.plans.locate import slices
from larkfield.plans.text_queries import table
from larkfield.sources import git

#: Code of each language with two words of a text ({w} and {u}), lower-case and capitalised ({W} and {U}).
CODE = {
    "python": "import {w}\nfrom {u}.x import y\nclass {W}:\n    def {w}(self):\n        return '{u}'  # {w} {u}\n",
    "ruby": "require '{w}'\nmodule {W}\n  class {U}\n    def {w}\n      {U}.new\n    end\n  end\nend\n",
    "ts": "import {{ a }} from './{w}';\nexport class {W} {{\n  {u}() {{ return 1; }}\n}}\nconst {u}C = 2;\n// {w}\n".replace("{{", "{").replace("}}", "}"),
    "js": "const {w} = require('{u}');\nfunction {u}() { return `{w}`; }\n",
}
#: What that code holds: (name, kind, first and last line), (hint, kind), texts as written.
SYMBOLS = {
    "python": (("{W}", "class", 2, 4), ("{w}", "function", 3, 4)), "ruby": (("{W}", "module", 1, 7), ("{U}", "class", 2, 6), ("{w}", "method", 3, 5)),
    "ts": (("{W}", "class", 1, 3), ("{u}", "method", 2, 2), ("{u}C", "const", 4, 4)), "js": (("{w}", "const", 0, 0), ("{u}", "function", 1, 1)),
}
IMPORTS = {
    "python": (("{w}", "import"), ("{u}.x", "import")), "ruby": (("{w}", "require"), ("{W}", "ruby_const"), ("{U}", "ruby_const"), ("{U}", "ruby_const")),
    "ts": (("./{w}", "import"),), "js": (("{u}", "require"),),
}
TEXTS = {"python": "'{u}'|# {w} {u}", "ruby": "'{w}'", "ts": "'./{w}'|// {w}", "js": "'{u}'|`{w}`"}


def code(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, lang, text) made of the words of conversations."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{3,}"), F.lit(0))
    w, u = F.coalesce(F.get(found, F.lit(0)), F.lit("word")), F.coalesce(F.get(found, F.lit(1)), F.lit("other"))
    names = {"{w}": F.concat(F.lit("w_"), w), "{u}": F.concat(F.lit("u_"), u), "{W}": F.concat(F.lit("W_"), w), "{U}": F.concat(F.lit("U_"), u)}
    lang, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, template) in enumerate(CODE.items()):
        made = F.lit(template)
        for slot, value in names.items():
            made = F.replace(made, F.lit(slot), value)
        lang, source = F.when(F.col("turn") % 4 == i, name).otherwise(lang), F.when(F.col("turn") % 4 == i, made).otherwise(source)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lang.alias("lang"), source.alias("text"))


def extracted_symbols(spark, sf_dir):
    rows = extract.with_extracted(code(spark, sf_dir)).select("conv_id", "turn", F.explode("symbols").alias("s"))
    return rows.select("conv_id", "turn", "s.name", "s.kind", "s.start_line", "s.end_line")


def extracted_imports(spark, sf_dir):
    return extract.with_extracted(code(spark, sf_dir)).select("conv_id", "turn", F.explode("imports").alias("i")).select("conv_id", "turn", "i.hint", "i.kind")


def extracted_texts(spark, sf_dir):
    return extract.with_extracted(code(spark, sf_dir)).select("conv_id", "turn", F.array_join("texts", "|").alias("texts"))


def parsed_log(spark, sf_dir):
    """A log for every thousand orders, an order a commit and its parts the files; headers of every eleventh lack the time."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    source, key = F.expr("o_orderkey div 1000").cast("string"), F.col("o_orderkey")
    header = F.concat_ws(" ", F.lit(git.HEADER), key.cast("string"), F.when(key % 11 != 0, F.col("ts").cast("string")))
    heads = orders.select(source.alias("source"), (key * 10_000).alias("line_no"), header.alias("line"))
    items = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == key)
    files = items.select(source.alias("source"), (key * 10_000 + 1 + F.col("l_linenumber")).alias("line_no"), F.concat(F.lit(" p"), F.col("l_partkey").cast("string")).alias("line"))
    log = git.parse_log(heads.unionByName(files))
    return log.select("sha", "ts", F.array_join(F.array_sort("files"), ",").alias("files"))


#: Paths of calls below /r/a ({w} is a word), called from /r/a/b, with what they come to (None: they lead out).
PATHS = (
    ("{w}.rb", "b/{w}.rb"), ("/r/a/{w}", "{w}"), ("../{w}", "{w}"), ("../../{w}", None), ("/r/a", None), ("/r/ab/{w}", None), ("./x//y/../{w}", "b/x/{w}"), ("/r/a/b/../../{w}", None),
)


def paths_below(spark, sf_dir):
    """Paths of calls, taken below the root of a checkout."""
    found = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), "[a-z]{3,}", 0), F.lit("")), F.lit("word"))
    at = ((F.length(F.coalesce("text", F.lit(""))) + F.col("turn")) % len(PATHS) + 1).cast("int")
    path = F.replace(F.element_at(F.lit([p for p, _ in PATHS]), at), F.lit("{w}"), found)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", events.inside(F.lit("/r/a"), path, F.lit("/r/a/b")).alias("path"))


def answers(spark, sf_dir):
    """Tokens that look like identifiers, the reason that a text gives for an unserved call, and the sub-command it asks for."""
    body = F.coalesce("text", F.lit(""))
    odd = F.concat_ws(" ", body, F.when(F.col("turn") % 3 == 0, "is disabled").when(F.col("turn") % 3 == 1, "not inside a git checkout"))
    asked = F.concat_ws(" ", F.when(F.col("turn") % 2 == 0, "reindex").when(F.col("turn") % 5 == 1, "stats"), F.substring(body, 1, 12))
    command = classify.sub_command(asked)
    tokens = text.white_space_tokens(body)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(F.filter(tokens, text.identifier_like)).alias("n_identifiers"), classify.unavailable_reason(odd).alias("reason"),
        command["sub"].alias("sub"), command["path"].alias("path"),
    )


#: Results of calls that were served.
SHOWN = '{"results":[{"path":"{w}.rb"},{"path":"b.rb"}],"cluster":{"cochange":["c.rb"],"referrers":[]},"confidence":"high"}'
SLICED = '{"path":"/r/c.rb","stale_index":true}'


def dispatched_calls(spark, sf_dir):
    """Calls of seven kinds, a conversation a session: the rows they give, with the numbers that only those rows use up."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{3,}"), F.lit(0))
    w = F.coalesce(F.get(found, F.lit(0)), F.lit("word"))
    at = (F.length(F.coalesce("text", F.lit(""))) + F.col("turn")) % 7
    of = lambda *values: F.element_at(F.array(*[v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string") for v in values]), (at + 1).cast("int"))
    calls = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") * 1_000).alias("ts"), F.col("turn").cast("int").alias("turn"), of("locate", "locate", "slice", "read", "read", "bash", "edit").alias("tool"),
        F.create_map(
            F.lit("query"), F.concat_ws(" ", w, w), F.lit("path"), of(None, None, None, "b.rb", "../../etc", None, None), F.lit("command"), of(None, None, None, None, None, F.concat(F.lit("cd x && rg "), w), None),
        ).alias("args"),
        of(F.replace(F.lit(SHOWN), F.lit("{w}"), w), None, SLICED, None, None, None, None).alias("details"), F.lit("it is disabled here").alias("content"),
        F.lit(False).alias("is_error"), F.lit("/r").alias("root"), F.lit("/r").alias("cwd"),
    )
    made = events.dispatch(calls)
    locates, used = made["locates"], sessions.attribute_ring(made["locates"], made["consumes"])
    place = F.coalesce(F.col("locate_rank").cast("string"), "cluster_kind", F.lit("-"))
    return (
        locates.select("session_id", "seq", "turn", F.lit("locate").alias("kind"), F.concat_ws(" ", "query_type", F.col("result_count").cast("string"), "confidence").alias("what"))
        .unionByName(used.select("session_id", "seq", "turn", "kind", F.concat_ws(" ", "path", "search_tool", "search_pattern", place).alias("what")))
        .unionByName(made["unavailable"].select("session_id", "seq", "turn", F.lit("unavailable").alias("kind"), F.concat_ws(" ", "tool", "reason").alias("what")))
    )


def file_slices(spark, sf_dir):
    """Slices of documents by lines and by symbol, and requests that are refused; every fourth document has changed since."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    own = F.concat(F.lit("docs/"), key.cast("string"), F.lit(".md"))
    of = lambda *values: F.element_at(F.array(*[v if not isinstance(v, (str, int, type(None))) else F.lit(v) for v in values]), (key % 6 + 1).cast("int"))
    requests = docs.select(
        key.alias("request_id"), of(own, F.concat(F.lit("@"), own), "../x.md", ".env", "missing.md", own).alias("path"), of(None, "S", None, None, None, "Absent").cast("string").alias("symbol"),
        of(2, None, 1, 1, 1, None).cast("int").alias("start_line"), of(4, None, 9, 9, 9, None).cast("int").alias("end_line"),
    )
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    files = docs.select(own.alias("path"), "text", digest.alias("content_hash"), F.when(key % 4 == 0, "x").otherwise(digest).alias("indexed_hash"), key.alias("file_id"))
    line = (key % 5).cast("int")
    symbols = docs.select(key.alias("file_id"), F.lit("S").alias("name"), F.explode(F.array(F.struct((line + 3).alias("start_line"), (line + 4).alias("end_line")), F.struct(line.alias("start_line"), (line + 1).alias("end_line")))).alias("s"))
    return slices(requests, files, symbols.select("file_id", "name", "s.start_line", "s.end_line")).drop("path")


QUERIES = {f.__name__: f for f in (extracted_symbols, extracted_imports, extracted_texts, parsed_log, paths_below, answers, dispatched_calls, file_slices)}

_WORDS = """WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[a-z]{3,}') AS ws FROM conversations),
    c AS (SELECT conv_id, turn, coalesce(ws[1], 'word') AS w, coalesce(ws[2], 'other') AS u FROM t)
"""


def _sql(template: str) -> str:
    """A template as an expression over the words."""
    out = "'" + template.replace("'", "''") + "'"
    for slot, value in (("{w}", "'w_' || w"), ("{u}", "'u_' || u"), ("{W}", "'W_' || w"), ("{U}", "'U_' || u")):
        out = out.replace(slot, "' || " + value + " || '")
    return f"({out})"


def _union(held: dict, columns) -> str:
    parts = [f"SELECT conv_id, turn, {columns(x)} FROM c WHERE turn % 4 = {i}" for i, lang in enumerate(CODE) for x in held[lang]]
    return _WORDS + " UNION ALL ".join(parts)


_WS = "list_filter(string_split_regex(trim({}, ' \t\n\r\x0b\x0c'), '\\s+'), lambda t: t <> '')"
SQL = {
    "extracted_symbols": _union(SYMBOLS, lambda x: f"{_sql(x[0])} AS name, '{x[1]}' AS kind, {x[2]} AS start_line, {x[3]} AS end_line"),
    "extracted_imports": _union(IMPORTS, lambda x: f"{_sql(x[0])} AS hint, '{x[1]}' AS kind"),
    "extracted_texts": _union({lang: [x] for lang, x in TEXTS.items()}, lambda x: f"{_sql(x)} AS texts"),
    "parsed_log": """WITH o AS (SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderkey // 1000 AS source, o_orderkey % 11 <> 0 AS good FROM orders),
        m AS (SELECT *, max(CASE WHEN good THEN k END) OVER (PARTITION BY source ORDER BY k) AS owner FROM o),
        f AS (SELECT owner, list_sort(list(concat('p', l_partkey))) AS files FROM m JOIN lineitem ON l_orderkey = k WHERE owner IS NOT NULL GROUP BY 1)
        SELECT CAST(k AS VARCHAR) AS sha, ts, coalesce(array_to_string(files, ','), '') AS files FROM o LEFT JOIN f ON owner = k WHERE good""",
    "dispatched_calls": """WITH t AS (SELECT conv_id AS session_id, turn, (length(coalesce(text, '')) + turn) % 7 AS c, coalesce(regexp_extract_all(coalesce(text, ''), '[a-z]{3,}')[1], 'word') AS w FROM conversations),
        k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS seq FROM t WHERE c NOT IN (4, 6)),
        n AS (SELECT *, count(*) FILTER (c = 0) OVER (PARTITION BY session_id ORDER BY turn) AS locates FROM k)
        SELECT session_id, seq, turn, CASE c WHEN 0 THEN 'locate' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'slice' WHEN 3 THEN 'read' ELSE 'search' END AS kind,
        CASE c WHEN 0 THEN 'keyword 2 high' WHEN 1 THEN 'locate disabled' WHEN 2 THEN concat('c.rb ', CASE WHEN locates > 0 THEN 'cochange' ELSE '-' END)
        WHEN 3 THEN concat('b.rb ', CASE WHEN locates > 0 THEN '2' ELSE '-' END) ELSE concat('rg ', w, ' -') END AS what FROM n""",
    "file_slices": """WITH d AS (SELECT doc_id, doc_id % 6 AS c, string_split(text, chr(10)) AS ls FROM documents),
        e AS (SELECT *, CASE WHEN c IN (2, 3) THEN 'forbidden path' WHEN c = 4 OR ls IS NULL THEN 'no such file' WHEN c = 5 THEN 'no such symbol' END AS error,
        CASE c WHEN 0 THEN 2 ELSE doc_id % 5 + 1 END AS lo, CASE c WHEN 0 THEN 4 ELSE doc_id % 5 + 2 END AS hi FROM d),
        p AS (SELECT *, greatest(1, least(lo, len(ls))) AS a FROM e), q AS (SELECT *, greatest(a, least(hi, len(ls))) AS b FROM p)
        SELECT doc_id AS request_id, CASE WHEN error IS NULL THEN CAST(a - 1 AS INT) END AS start_line, CASE WHEN error IS NULL THEN CAST(b - 1 AS INT) END AS end_line,
        CASE WHEN error IS NULL THEN array_to_string(ls[a:b], chr(10)) END AS body, c NOT IN (2, 3, 4) AND doc_id % 4 = 0 AS stale, error FROM q""",
    "paths_below": f"""WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(nullif(regexp_extract(coalesce(text, ''), '[a-z]{{3,}}'), ''), 'word') AS w FROM conversations)
        SELECT conv_id, turn, replace(([{', '.join('NULL' if p is None else f"'{p}'" for _, p in PATHS)}])[(n + turn) % {len(PATHS)} + 1], '{{w}}', w) AS path FROM c""",
    "answers": f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations),
        a AS (SELECT *, concat(x, CASE turn % 3 WHEN 0 THEN ' is disabled' WHEN 1 THEN ' not inside a git checkout' ELSE '' END) AS odd,
        {_WS.format("concat(CASE WHEN turn % 2 = 0 THEN 'reindex ' WHEN turn % 5 = 1 THEN 'stats ' ELSE '' END, x[1:12])")} AS ts FROM c)
        SELECT conv_id, turn, len(list_filter({_WS.format('x')}, lambda t: regexp_matches(t, '_|[0-9]|[a-z][A-Z]'))) AS n_identifiers,
        CASE WHEN contains(odd, 'not inside a git') OR contains(odd, 'not a git') THEN 'non_git' WHEN contains(odd, 'disabled') THEN 'disabled' ELSE 'booting' END AS reason,
        CASE WHEN ts[1] IN ('reindex', 'stats') THEN ts[1] ELSE 'status' END AS sub,
        CASE WHEN ts[1] = 'reindex' AND len(ts) > 1 THEN array_to_string(ts[2:], ' ') END AS path FROM a""",
}
