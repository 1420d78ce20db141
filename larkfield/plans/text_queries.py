"""Text queries over the driver's documents, benchmark, pages, parts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.functions import classify, ranking, text
from larkfield.operators import evaluate, postings, search, substrings
from larkfield.plans.graph_queries import NOW
from larkfield.plans.locate import slice_lines
from larkfield.sources import files as file_source

WEIGHTS = {"source": 4.0, "text": 0.5}


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_queries(spark, sf_dir, words: int = 4, tail: str = "") -> DataFrame:
    """A query for each benchmark item: its first words."""
    tokens = text.white_space_tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.slice(tokens, 1, words), F.lit(tail or None)).alias("query"))


def prose_tokens_df(spark, sf_dir):
    """Document frequencies of prose tokens; junk and stop words are told from the terms that were counted, once each."""
    terms = F.explode(text.raw_prose_tokens(F.col("text")))
    counted = table(spark, sf_dir, "documents").select(terms.alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.where(~text.is_junk(F.col("term")) & ~F.col("term").isin(text.stoplist("prose")))


def identifier_split(spark, sf_dir):
    name = F.concat(F.initcap("p_name"), F.lit("HTTPServer_"), F.regexp_replace("p_brand", "#", "."), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_identifier(F.regexp_replace(name, " ", "")), " ").alias("parts"))


def keyword_filter(spark, sf_dir):
    raw = text.white_space_tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.keywords(raw, text.stoplist("python", ["the"])), " ").alias("words"))


def kept_index(spark, sf_dir, fields: list[str]) -> postings.PostingsIndex:
    """Postings of the documents, written at their first use and read by every later query of the application."""
    return postings.kept(spark, f"{sf_dir}/documents.parquet", fields)


def bm25_topk(spark, sf_dir):
    out = kept_index(spark, sf_dir, ["text"]).match(short_queries(spark, sf_dir), {"text": 1.0}, k=10)
    return out.select("query_id", "doc_id", F.round("b", 6).alias("b"), "n_hit", "rank")


def and_or_fallback(spark, sf_dir):
    odd = short_queries(spark, sf_dir, 2).withColumn("query", F.when(F.col("query_id") % 2 == 0, F.concat("query", F.lit(" zebraword"))).otherwise(F.col("query")))
    scored = kept_index(spark, sf_dir, ["text"]).score(search.query_phrases(odd), {"text": 1.0})
    # Rows with all terms and others are counted apart before one of both is taken, so no scored row is read twice.
    counted = scored.groupBy("query_id", (F.col("n_hit") == F.col("n_terms")).alias("whole")).agg(F.count("*").alias("n_docs"), F.max("n_hit").alias("n_hit"), F.max("n_terms").alias("n_terms"))
    return search.all_or_any(counted).select("query_id", "used_or", "n_docs", F.col("n_hit").alias("most_terms"))


def fielded_bm25(spark, sf_dir):
    out = kept_index(spark, sf_dir, list(WEIGHTS)).score(search.query_phrases(short_queries(spark, sf_dir, 2, "src3")), WEIGHTS)
    return out.select("query_id", "doc_id", "n_hit", (F.round("b", 6) + 0.0).alias("b"))


def phrase_match(spark, sf_dir):
    tokens = text.index_terms(F.col("text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(tokens, 1, 2), "-").alias("query"))
    return kept_index(spark, sf_dir, ["text"]).hits(search.query_phrases(asked), {"text": 1.0}).select("query_id", "doc_id", "tf")


def stemmed_bm25(spark, sf_dir):
    """Stems are expanded over the kept index, so texts are not cut again."""
    return kept_index(spark, sf_dir, list(WEIGHTS)).match(short_queries(spark, sf_dir), WEIGHTS, k=10, stem=True)


def _page_paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))


def path_match_signal(spark, sf_dir):
    tokens = F.lit(["25", "BLOG", "tion", "page.html"])
    return _page_paths(spark, sf_dir).select("page_id", ranking.path_match(tokens, F.col("path")).alias("signal"))


def test_penalty(spark, sf_dir):
    path = F.concat(F.element_at(F.lit(["spec/", "app/tests/", "lib/", "src/"]), (F.col("page_id") % 4 + 1).cast("int")), F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.lit(["_test.rb", ".spec.ts", ".py"]), (F.col("page_id") % 3 + 1).cast("int")))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", ranking.is_test_path(F.col("path")).alias("is_test"), ranking.penalised(F.lit(2.0) + F.col("page_id") % 5, F.col("path")).alias("score"))


def fused_rank(spark, sf_dir):
    """Signals of documents for each query, fused; ties end by the id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    found = kept_index(spark, sf_dir, list(WEIGHTS)).match(short_queries(spark, sf_dir, 3), WEIGHTS, k=50)
    rows = found.join(docs.drop("text"), "doc_id")
    worst = F.max("b").over(search.W.partitionBy("query_id"))
    path = F.concat(F.lit("docs/"), "source", F.lit(".md"))
    rows = rows.withColumns({"path_signal": ranking.path_match(F.array(F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))), path), "recency": ranking.recency_boost(F.col("doc_id") % 13, F.lit(NOW) - F.col("n_chars") * 1000, NOW)})
    score = ranking.fused_score(worst - F.col("b"), F.col("path_signal"), F.lit(0.0), F.col("recency"))
    top = search.ranked(rows.withColumn("score", F.round(score, 6)).drop("rank"), 5, F.desc("score"), F.asc("doc_id"))
    return top.select("query_id", "rank", "doc_id", "score")


def confidence_flag(spark, sf_dir):
    label = table(spark, sf_dir, "labels")
    verdict = ranking.confidence(F.col("quality") == 0, F.col("doc_id") % 3 == 0, F.col("doc_id") % 4, F.col("toxic") == 0)
    return label.select("doc_id", verdict.alias("confidence"), ranking.strong_hit(F.col("doc_id") % 5, F.col("quality") == 1, F.col("toxic") == 0).alias("strong"))


def query_classify(spark, sf_dir):
    asked = F.array_join(F.slice(text.white_space_tokens(F.col("text")), 1, (F.col("turn") % 5).cast("int")), " ")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("query"))
    return rows.select("conv_id", "turn", classify.query_type(F.col("query")).alias("query_type"), F.size(text.white_space_tokens(F.col("query"))).alias("n_tokens"))


def _words(column: str = "text") -> tuple:
    """Two lower-case words of a text, for inputs that are composed of its content."""
    found = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit("[a-z]{3,}"), F.lit(0))
    return F.coalesce(F.get(found, F.lit(0)), F.lit("word")), F.coalesce(F.get(found, F.lit(1)), F.lit("other"))


def _choice(options, salt: int):
    """One of the options by the length of the text and the turn."""
    at = (F.coalesce(F.length("text"), F.lit(0)) * salt + F.col("turn")) % len(options)
    return F.element_at(F.array(*[o if not isinstance(o, str) else F.lit(o) for o in options]), (at + 1).cast("int"))


#: What is put between words of conversations to make prompts of all kinds.
PHRASES = (
    "", "src/app.ts", "what branch am i on", "investigate the crash", "https://example.com/x", "fix pr comments", "pr comments please", "README.md", "sentry",
    "where is it implemented", "lib/a/b.test.rb:10:2,", "explain how", "git status without asking for code impact", "needs changing", "slack", "./x/y.py)", "add support",
)


def prompt_classify(spark, sf_dir):
    w, u = _words()
    prompt = F.when(F.col("turn") % 11 == 7, F.lit("  ")).otherwise(F.concat_ws(" ", w, _choice(PHRASES, 1), u, _choice(PHRASES, 7)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.prompt_class(prompt).alias("kind"))


#: Simple commands with what each searches for ({w} and {u} are words), and what joins them.
SEARCHES = (
    ("ls {w}", None, None), ("rg -n '{w} {u}' src", "rg", "{w} {u}"), ("git grep {w}", "git-grep", "{w}"), ('grep -rn "{w}; {u} | x" .', "grep", "{w}; {u} | x"),
    ("find . -iname '*{w}*'", "find", "*{w}*"), ("fdfind {w}", "fd", "{w}"), ("egrep {w} x.txt", "grep", "{w}"), ("ack --ruby {w}", "ack", "{w}"), ("echo rg {w}", None, None),
    ("find . -type f", None, None), ("rg --files", None, None), ("ag '{u}'", "ag", "{u}"), ("fd -H {w}", "fd", "{w}"),
)
GREPS = (
    ("grep -rn {w} src", "symbol"), ("grep {w} a.txt", None), ("grep -R '{w}.{u}'", "regex"), ("egrep {w} lib/", "symbol"), ("git grep {w}", None), ("echo $(grep -r {w})", "symbol"),
    ("fgrep -e {w} -r src", "symbol"), ("cat x | grep {w}", None), ("grep --help -r {w} src", None), ("grep -ri '{w} {u}' .", "regex"), ("ls src", None), ("grep --recursive {w}", "symbol"),
)
JOINTS = (" && ", " | ", " ; ", " || ", "\n", "; ")


def _composed(templates, w, u, joint_salt: int = 5):
    def filled(template: str):
        return F.replace(F.replace(F.lit(template), F.lit("{w}"), w), F.lit("{u}"), u)

    parts = [_choice([filled(t[0]) for t in templates], salt) for salt in (1, 3, 7)]
    return F.concat(parts[0], _choice(JOINTS, joint_salt), parts[1], _choice(JOINTS, joint_salt + 6), parts[2])


def search_commands(spark, sf_dir):
    """Commands of three simple ones with words of the text: what is searched for first, filters of pipes apart."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _composed(SEARCHES, *_words()).alias("command"))
    return classify.with_searches(rows).select("conv_id", "turn", "search.tool", "search.pattern")


def grep_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _composed(GREPS, *_words()).alias("command"))
    rows = classify.with_grep_class(rows, ["src", "lib", "."])
    return rows.select("conv_id", "turn", "grep.kind", classify.guard_action(F.col("grep.scans"), F.col("turn") < 5, F.col("turn") != 2).alias("action"))


def underscore_paths(spark, sf_dir):
    name = F.concat(F.lit("HTTPServer::"), F.initcap("p_name"), F.lit("V2Item"))
    return table(spark, sf_dir, "part").select("p_partkey", text.underscore_constant(F.regexp_replace(name, " ", "")).alias("path"))


#: What stands before and behind words of pages to make paths of all kinds.
FOLDERS = ("", "src/", "app/node_modules/lib/", "dist/", "node_modules_x/", "a/.git/", "vendor/", "build.d/", ".venv/", "Coverage/")
FRONTS, BACKS = ("", ".env", "id_", ".", "x.", "ID_", "env"), (".rb", ".TSX", "", ".pem", ".md", ".Key", ".jsx", ".py", ".txt.gz", ".cjs", ".markdown", ".P12", ".rst", ".mts", ".pfx", ".adoc", ".")


def url_languages(spark, sf_dir):
    """Paths of words of pages: their language, and whether they are secret or below an ignored folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    word = F.regexp_extract(html, "<title>([A-Za-z]*)", 1)

    def choice(options, salt):
        return F.element_at(F.lit(list(options)), ((F.length(html) * salt + F.col("page_id")) % len(options) + 1).cast("int"))

    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(choice(FOLDERS, 3), choice(FRONTS, 5), word, choice(BACKS, 1)).alias("path"))
    return rows.select("page_id", file_source.language(F.col("path")).alias("lang"), file_source.is_secret(F.col("path")).alias("secret"), file_source.has_ignored_segment(F.col("path")).alias("ignored"))


def line_slices(spark, sf_dir):
    start, end = (F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 7 + 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", slice_lines(F.col("text"), start, end).alias("body"))


def scan_baseline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return evaluate.scan_baseline(kept_index(spark, sf_dir, ["text"]), docs, short_queries(spark, sf_dir, 6))


def eval_hits(spark, sf_dir):
    """Retrieval quality on benchmark items: documents that hold the whole item are expected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    index = kept_index(spark, sf_dir, ["text"])
    expect = substrings.containing(index, docs, items).join(items, "needle").groupBy("query_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".")))).alias("expect"))
    none = F.lit(None).cast("string")
    cases = expect.select("query_id", "expect", none.alias("expect_prefix"), none.alias("expect_contains"), none.alias("expect_not_suffix"))
    found = index.match(short_queries(spark, sf_dir, 8), {"text": 1.0}, k=5)
    results = found.select("query_id", "rank", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".")).alias("path"))
    return evaluate.judge(results, cases)


#: What the cases of ``eval_kinds`` ask for, by the query's id: a suffix the first result must not have, a prefix, a part, a list.
ASKED = ("3.", "doc-1", "7", ["doc-2", "doc-45.x"])


def eval_kinds(spark, sf_dir):
    """Verdicts of all kinds of expectations on the ranked documents of each benchmark item."""
    kind = F.col("item_id") % 4
    wanted = [F.when(kind == i, F.lit(a)).alias(n) for i, (n, a) in enumerate(zip(("expect_not_suffix", "expect_prefix", "expect_contains", "expect"), ASKED))]
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), *wanted)
    found = kept_index(spark, sf_dir, ["text"]).match(short_queries(spark, sf_dir, 2), {"text": 1.0}, k=5)
    return evaluate.judge(found.select("query_id", "rank", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".")).alias("path")), cases)


QUERIES = {f.__name__: f for f in (
    prose_tokens_df, identifier_split, keyword_filter, bm25_topk, and_or_fallback, fielded_bm25, phrase_match, stemmed_bm25, path_match_signal,
    test_penalty, fused_rank, confidence_flag, query_classify, prompt_classify, search_commands, grep_guard, underscore_paths, url_languages,
    line_slices, scan_baseline, eval_hits, eval_kinds,
)}

_FOLD = f"translate(lower({{}}), '{text.MARKED}', '{text.PLAIN}')"
_TERMS = "list_filter(string_split_regex(" + _FOLD + ", '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_WS = "list_filter(string_split_regex(trim({}, ' \t\n\r\x0b\x0c'), '\\s+'), lambda t: t <> '')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _junk(t: str) -> str:
    return f"(length({t}) < 3 OR regexp_full_match({t}, '[0-9]+') OR regexp_full_match({t}, '[0-9a-fA-F]{{6,}}') OR regexp_matches({t}, '^(?i)[a-z]+://'))"


def _asked(words: int, tail: str = "") -> str:
    return f"SELECT item_id AS query_id, concat(array_to_string(({_WS.format('text')})[1:{words}], ' '), '{(' ' + tail) if tail else ''}') AS query FROM benchmark"


def _bm25(fields: dict[str, float], asked: str) -> str:
    """CTEs: q (one row a white-space token), s (b of each query and document)."""
    posts = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, CAST({w} AS DOUBLE) AS w, {_TERMS.format(f'coalesce({f}, {chr(39) * 2})')} AS terms FROM documents" for f, w in fields.items())
    return f"""
WITH d AS ({posts}),
len AS (SELECT doc_id, sum(len(terms)) AS length FROM d GROUP BY 1),
st AS (SELECT count(*) AS n, avg(length) AS m FROM len),
asked AS ({asked}),
tk AS (SELECT query_id, {_WS.format('query')} AS toks FROM asked),
q AS (SELECT query_id, len(toks) AS n_terms, i AS term_no, {_TERMS.format('toks[i]')} AS ph FROM (SELECT query_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM tk)),
p AS (SELECT doc_id, w, terms, unnest(range(1, len(terms) + 1)) AS pos FROM d),
fl AS (SELECT doc_id, w, terms, pos, terms[pos] AS term FROM p),
h AS (SELECT query_id, n_terms, term_no, doc_id, sum(w) AS tf FROM q JOIN fl ON fl.term = q.ph[1] AND fl.terms[pos : pos + len(ph) - 1] = ph GROUP BY ALL),
df AS (SELECT query_id, term_no, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT query_id, n_terms, doc_id, count(*) AS n_hit, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))) AS b FROM h JOIN df USING (query_id, term_no) JOIN len USING (doc_id), st GROUP BY ALL),
k AS (SELECT s.*, NOT a.has_all AS used_or FROM s JOIN (SELECT query_id, bool_or(n_hit = n_terms) AS has_all FROM s GROUP BY 1) a USING (query_id) WHERE n_hit = n_terms OR NOT has_all)
"""


_LINES = "string_split(text, chr(10))"
_TEST = ranking.TEST_PATH.replace("'", "''")
_LANG = " ".join(f"WHEN regexp_extract(path, '[^/.][^/]*\\.([^./]+)$', 1, 'i') <> '' AND lower(regexp_extract(path, '[^/.][^/]*\\.([^./]+)$', 1)) IN ({', '.join(repr(x) for x in names)}) THEN '{lang}'" for lang, names in file_source.LANGUAGES.items())



def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_choice(options, salt: int) -> str:
    return f"([{', '.join('NULL' if o is None else o for o in options)}])[(n * {salt} + turn) % {len(options)} + 1]"


def _page_choice(options, salt: int) -> str:
    return f"([{', '.join(map(_quoted, options))}])[(length(coalesce(html, '')) * {salt} + page_id) % {len(options)} + 1]"


def _filled(template: str) -> str:
    return "replace(replace(" + _quoted(template) + ", '{w}', w), '{u}', u)"


def _part(templates, salt: int, joint: str | None) -> str:
    """What one simple command searches for, as its template states it, and whether a pipe feeds it."""
    made = [f"{{'tool': {'NULL::VARCHAR' if tool is None else _quoted(tool)}, 'pattern': {'NULL::VARCHAR' if tool is None else _filled(pattern)}, 'piped': {'false' if joint is None else joint + ' = ' + _quoted(' | ')}}}" for _, tool, pattern in templates]
    return _sql_choice(made, salt)


_COMMANDS = f"""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, regexp_extract_all(coalesce(text, ''), '[a-z]{{3,}}') AS ws FROM conversations),
    c AS (SELECT conv_id, turn, n, coalesce(ws[1], 'word') AS w, coalesce(ws[2], 'other') AS u, {_sql_choice([_quoted(j) for j in JOINTS], 5)} AS j1, {_sql_choice([_quoted(j) for j in JOINTS], 11)} AS j2 FROM t)
"""
_PATHS = [p.replace(classify._EDGE, r"($|[\s)\"'`.,!?])").replace("'", "''") for p in classify.EXACT_PATH]
_PROMPT_SQL = _COMMANDS + f""", p AS (SELECT conv_id, turn, CASE WHEN turn % 11 = 7 THEN '  ' ELSE concat_ws(' ', w, {_sql_choice(list(map(_quoted, PHRASES)), 1)}, u, {_sql_choice(list(map(_quoted, PHRASES)), 7)}) END AS x FROM c),
    f AS (SELECT conv_id, turn, trim(x) = '' AS nothing, regexp_matches(x, '{_PATHS[0]}') OR regexp_matches(x, '{_PATHS[1]}') AS path,
        regexp_matches(replace(lower(trim(x)), 'without asking for code impact', ' '), '{classify.CODE_CHANGE}') AS code, regexp_matches(lower(trim(x)), '{classify.BROAD}') AS broad,
        regexp_matches(lower(trim(x)), '{classify.REVIEW_COMMENTS}') AS review, regexp_matches(lower(trim(x)), 'https?://') OR regexp_matches(lower(trim(x)), '{classify.EXTERNAL}') AS outward FROM p)
    SELECT conv_id, turn, CASE WHEN nothing OR path OR (review AND NOT code) OR (NOT (broad OR code) AND outward) THEN 'skip_nudge' ELSE 'likely_orientation' END AS kind FROM f"""

SQL = {
    "prose_tokens_df": f"""SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(text,
        '{text.URL}', ' ', 'g')), '[^a-z0-9_]+'), lambda t: NOT {_junk('t')} AND NOT list_contains({_list(text.stoplist('prose'))}, t)))) AS term
        FROM documents) GROUP BY 1""",
    "identifier_split": """SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(concat(
        upper(split_part(p_name, ' ', 1)[1]), split_part(p_name, ' ', 1)[2:], upper(split_part(p_name, ' ', 2)[1]), split_part(p_name, ' ', 2)[2:],
        'HTTPServer_', replace(p_brand, '#', '.'), p_type), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'),
        lambda t: t <> ''), ' ') AS parts FROM part""",
    "keyword_filter": f"""WITH r AS (SELECT conv_id, turn, unnest({_WS.format('text')}) AS raw, generate_subscripts({_WS.format('text')}, 1) AS i FROM conversations),
        f AS (SELECT conv_id, turn, i, unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(raw, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
        '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')) AS t FROM r WHERE NOT regexp_matches(raw, '^(?i)[a-z]+://')),
        g AS (SELECT conv_id, turn, t, min(i) AS i FROM f WHERE NOT {_junk('t')} AND NOT list_contains({_list(text.stoplist('python', ['the']))}, t) GROUP BY ALL),
        n AS (SELECT f.conv_id, f.turn, f.t, f.i, row_number() OVER () AS o FROM f)
        SELECT c.conv_id, c.turn, coalesce(w.words, '') AS words FROM conversations c LEFT JOIN (SELECT conv_id, turn, array_to_string(list_distinct_ordered, ' ') AS words FROM (
        SELECT conv_id, turn, list(t ORDER BY o) AS list_distinct_ordered FROM (SELECT conv_id, turn, t, min(o) AS o FROM n JOIN g USING (conv_id, turn, t) GROUP BY ALL) GROUP BY ALL)) w
        USING (conv_id, turn)""",
    "bm25_topk": _bm25({"text": 1.0}, _asked(4)) + """SELECT query_id, doc_id, round(b, 6) AS b, n_hit, rank FROM (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY round(b, 9), doc_id) AS rank FROM k) WHERE rank <= 10""",
    "and_or_fallback": _bm25({"text": 1.0}, f"SELECT query_id, CASE WHEN query_id % 2 = 0 THEN concat(query, ' zebraword') ELSE query END AS query FROM ({_asked(2)})")
    + "SELECT query_id, used_or, count(*) AS n_docs, max(n_hit) AS most_terms FROM k GROUP BY ALL",
    "fielded_bm25": _bm25(WEIGHTS, _asked(2, "src3")) + "SELECT query_id, doc_id, n_hit, round(b, 6) + 0.0 AS b FROM s",
    "phrase_match": _bm25({"text": 1.0}, f"SELECT item_id AS query_id, array_to_string(({_TERMS.format('text')})[1:2], '-') AS query FROM benchmark")
    + "SELECT query_id, doc_id, tf FROM h",
    "path_match_signal": """WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^?#]*)', 1)) AS path FROM pages),
        x AS (SELECT *, regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM p)
        SELECT page_id, CAST(CASE WHEN stem IN ('25', 'blog', 'tion', 'page.html') THEN 1 WHEN len(list_filter(segs, lambda s: contains(s, '25') OR contains(s, 'blog')
        OR contains(s, 'tion') OR contains(s, 'page.html'))) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS signal FROM x""",
    "test_penalty": f"""WITH p AS (SELECT page_id, concat(['spec/', 'app/tests/', 'lib/', 'src/'][page_id % 4 + 1], 'f', page_id, ['_test.rb', '.spec.ts', '.py'][page_id % 3 + 1]) AS path FROM pages)
        SELECT page_id, regexp_matches(path, '{_TEST}') AS is_test, CAST(2.0 + page_id % 5 AS DOUBLE) * CASE WHEN regexp_matches(path, '{_TEST}') THEN 0.5 ELSE 1 END AS score FROM p""",
    "fused_rank": _bm25(WEIGHTS, _asked(3)) + f""", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 9), doc_id) AS r FROM k) WHERE r <= 50),
        g AS (SELECT query_id, doc_id, round(max(b) OVER (PARTITION BY query_id) - b + 3.5 * CASE WHEN source = concat('src', query_id % 20) THEN 1.0
        WHEN contains(source, concat('src', query_id % 20)) THEN 0.5 ELSE 0 END
        + 0.5 * (least(doc_id % 13, 10) / 10.0 + exp(-(n_chars * 1000) / 86400.0 / 90.0)) / 2.0, 6) AS score FROM t JOIN documents USING (doc_id))
        SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM g) WHERE rank <= 5""",
    "confidence_flag": """SELECT doc_id, CASE WHEN quality = 0 THEN 'high' WHEN (doc_id % 3 = 0 AND doc_id % 4 >= 2) OR toxic <> 0 THEN 'low' ELSE 'high' END AS confidence,
        doc_id % 5 > 0 AND quality = 1 AND toxic = 0 AS strong FROM labels""",
    "query_classify": f"""WITH q AS (SELECT conv_id, turn, ({_WS.format('text')})[1 : turn % 5] AS t FROM conversations)
        SELECT conv_id, turn, CASE WHEN len(t) = 1 AND (regexp_full_match(t[1], '[A-Za-z_][A-Za-z0-9_]*') OR regexp_matches(t[1], '[.:]')) THEN 'identifier'
        WHEN len(t) BETWEEN 2 AND 3 THEN 'keyword' ELSE 'open-ended' END AS query_type, len(t) AS n_tokens FROM q""",
    "prompt_classify": _PROMPT_SQL,
    "search_commands": _COMMANDS + f"""SELECT conv_id, turn, found.tool AS tool, found.pattern AS pattern FROM (
        SELECT conv_id, turn, list_filter([{_part(SEARCHES, 1, None)}, {_part(SEARCHES, 3, 'j1')}, {_part(SEARCHES, 7, 'j2')}], lambda x: x.tool IS NOT NULL AND NOT x.piped)[1] AS found FROM c)""",
    "grep_guard": _COMMANDS + f"""SELECT conv_id, turn, kind, CASE WHEN kind IS NULL OR turn >= 5 THEN 'allow' WHEN turn = 2 THEN 'warn' ELSE 'block' END AS action FROM (
        SELECT conv_id, turn, list_filter([{', '.join(_sql_choice([None if k is None else f"'{k}'" for _, k in GREPS], salt) for salt in (1, 3, 7))}], lambda x: x IS NOT NULL)[1] AS kind FROM c)""",
    "underscore_paths": """SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(concat('HTTPServer::', upper(split_part(p_name, ' ', 1)[1]), split_part(p_name, ' ', 1)[2:],
        upper(split_part(p_name, ' ', 2)[1]), split_part(p_name, ' ', 2)[2:], 'V2Item'), '::', '/'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'),
        '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS path FROM part""",
    "url_languages": f"""WITH p AS (SELECT page_id, concat({_page_choice(FOLDERS, 3)}, {_page_choice(FRONTS, 5)}, regexp_extract(coalesce(html, ''), '<title>([A-Za-z]*)', 1), {_page_choice(BACKS, 1)}) AS path FROM pages),
        n AS (SELECT page_id, string_split(path, '/') AS segs, lower(string_split(path, '/')[-1]) AS name FROM p),
        e AS (SELECT *, CASE WHEN len(string_split(name, '.')) > 1 AND length(ltrim(name, '.')) > length(string_split(name, '.')[-1]) + 1 THEN string_split(name, '.')[-1] ELSE '' END AS ext FROM n)
        SELECT page_id, CASE {' '.join(f"WHEN ext IN ({', '.join(repr(x) for x in names)}) THEN '{lang}'" for lang, names in file_source.LANGUAGES.items())} END AS lang,
        starts_with(name, '.env') OR starts_with(name, 'id_') OR regexp_matches(name, '[.](pem|key|p12|pfx)$') AS secret,
        len(list_filter(segs, lambda x: x IN ({', '.join(repr(x) for x in file_source.IGNORED)}))) > 0 AS ignored FROM e""",
    "line_slices": f"""WITH x AS (SELECT doc_id, {_LINES} AS ls, doc_id % 7 AS a FROM documents),
        y AS (SELECT doc_id, ls, greatest(1, least(a, len(ls))) AS lo, a FROM x)
        SELECT doc_id, array_to_string(ls[lo : greatest(lo, least(a + 2, len(ls)))], chr(10)) AS body FROM y""",
    "scan_baseline": f"""WITH q AS (SELECT query_id, (list_filter({_WS.format('query')}, lambda t: length(t) > 3))[1] AS token FROM ({_asked(6)}))
        SELECT query_id, count(DISTINCT doc_id) AS n_candidates FROM q LEFT JOIN documents ON contains(text, token) WHERE token IS NOT NULL GROUP BY 1""",
    "eval_kinds": _bm25({"text": 1.0}, _asked(2)) + f""", t AS (SELECT query_id, concat('doc-', doc_id, '.') AS path, r FROM (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY round(b, 9), doc_id) AS r FROM k) WHERE r <= 5),
        v AS (SELECT item_id AS query_id, r, CASE item_id % 4 WHEN 0 THEN NOT ends_with(path, '{ASKED[0]}') WHEN 1 THEN starts_with(path, '{ASKED[1]}')
        WHEN 2 THEN contains(path, '{ASKED[2]}') ELSE contains(path, '{ASKED[3][0]}') OR contains(path, '{ASKED[3][1]}') OR contains('{ASKED[3][0]}', path) OR contains('{ASKED[3][1]}', path) END AS ok
        FROM benchmark LEFT JOIN t ON query_id = item_id)
        SELECT query_id, coalesce(bool_or(ok) FILTER (r = 1), false) AS hit1, coalesce(bool_or(ok) FILTER (r = 1 OR query_id % 4 <> 0), false) AS hitk FROM v GROUP BY 1""",
    "eval_hits": _bm25({"text": 1.0}, _asked(8)) + """, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 9), doc_id) AS r FROM k) WHERE r <= 5),
        e AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
        SELECT query_id, coalesce(bool_or(r = 1), false) AS hit1, count(r) > 0 AS hitk FROM e LEFT JOIN t USING (query_id, doc_id) GROUP BY 1""",
}
