"""Classifiers of queries, prompts and shell commands."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.functions.text import white_space_tokens

# ---- queries -------------------------------------------------------------------------------------


def query_type(query: Column) -> Column:
    """identifier, keyword or open-ended."""
    tokens = white_space_tokens(F.coalesce(query, F.lit("")))
    n, first = F.size(tokens), F.get(tokens, F.lit(0))
    named = first.rlike("^[A-Za-z_][A-Za-z0-9_]*$") | first.rlike("[.:]")
    return F.when((n == 1) & named, "identifier").when((n >= 2) & (n <= 3), "keyword").otherwise("open-ended")


def unavailable_reason(text: Column) -> Column:
    outside = text.contains("not inside a git") | text.contains("not a git")
    return F.when(outside, "non_git").when(text.contains("disabled"), "disabled").otherwise("booting")


# ---- prompts -------------------------------------------------------------------------------------
# The phrases that tell prompts apart.
_EDGE = r"(?=$|[\s)\"'`.,!?])"
EXACT_PATH = (
    r"(?i)(^|[\s(\"'`])(?:\.\.?/)?(?:[\w.-]+/)+[\w.-]+(?:\.[a-z0-9]+)+(?::\d+(?::\d+)?)?" + _EDGE,
    r"(?i)(^|[\s(\"'`])(?:README\.md|AGENTS\.md|package\.json|[\w.-]+(?:\.test)?\.(?:ts|tsx|js|jsx|mjs|cjs|py|rb|md|json|toml|ya?ml))(?::\d+(?::\d+)?)?" + _EDGE,
)
CODE_CHANGE = r"(?i)\b(?:what code needs to change|code needs to change|identify implementation changes?|implementation changes?|what needs changing|needs changing|actionable code changes?|implementation|fix)\b"
BROAD = (
    r"(?i)\b(?:investigate|review\s+(?:this\s+)?(?:linear|ticket|issue|github issue|github pr|pr|pull request)|what needs changing|"
    r"what code needs to change|fix|add support|look into|is this actionable|explain how|find where)\b|\bwhere is\b.*\bimplemented\b"
)
REVIEW_COMMENTS = r"(?i)\b(?:github\s+)?pr comments?\b"
EXTERNAL = r"(?i)\b(?:what branch am i on|show git status|report git branch information only|git (?:branch|status|log)|slack|sentry|database schema)\b"
STRONG_COVERAGE = 0.9


def has_exact_path(prompt: Column) -> Column:
    return prompt.rlike(EXACT_PATH[0]) | prompt.rlike(EXACT_PATH[1])


def is_external_only(prompt: Column) -> Column:
    text = F.lower(F.trim(prompt))
    wants_code = F.regexp_replace(text, "(?i)without asking for code impact", " ").rlike(CODE_CHANGE)
    about = text.rlike(BROAD) | wants_code
    outward = text.rlike("https?://") | text.rlike(EXTERNAL)
    return (text != "") & ~has_exact_path(prompt) & ((text.rlike(REVIEW_COMMENTS) & ~wants_code) | (~about & outward))


def prompt_class(prompt: Column) -> Column:
    text = F.coalesce(prompt, F.lit(""))
    skip = (F.trim(text) == "") | has_exact_path(text) | is_external_only(text)
    return F.when(skip, "skip_nudge").otherwise("likely_orientation")


def guidance_tier(indexed: Column, total: Column, crawl_done: Column) -> Column:
    share = F.coalesce(F.try_divide(indexed, total), F.lit(0.0))
    return F.when((share >= STRONG_COVERAGE) & crawl_done, "strong").otherwise("weak")


def guidance_caveats(indexed: Column, dirty: Column, indexed_head: Column, head: Column) -> Column:
    """``booting`` while nothing is indexed; ``lagging`` if the tree is dirty or the index is of another commit."""
    moved = F.coalesce((indexed_head != "") & (head != "") & (indexed_head != head), F.lit(False))
    return F.array_compact(F.array(F.when(indexed == 0, "booting"), F.when(dirty | moved, "lagging")))


def persona_usable(resolved: Column, tools: Column, indexed: Column, failed: Column, tool: str = "locate") -> Column:
    """Whether standing guidance fits: some file is indexed, the writer lives and the tool is selected, fresh or not."""
    return F.coalesce(resolved & F.array_contains(tools, tool) & (indexed > 0) & ~failed, F.lit(False))


def guidance(
    prompt: Column, persona: Column, resolved: Column, tools: Column, indexed: Column, total: Column, crawl_done: Column, failed: Column,
    dirty: Column, indexed_head: Column, head: Column, nudge: Column, tool: str = "locate",
) -> Column:
    """What a prompt gets, in this order: the persona, a directive by tier, and caveats, which never come alone."""
    asked = F.coalesce(nudge & resolved & F.array_contains(tools, tool) & ~failed & (prompt_class(prompt) == "likely_orientation"), F.lit(False))
    share = F.format_string("%d of %d files are indexed: use it where it helps", indexed.cast("long"), total.cast("long"))
    strong = guidance_tier(indexed, total, crawl_done) == "strong"
    words = {"booting": "nothing is indexed yet", "lagging": "the index lags behind the files"}
    caveats = F.transform(guidance_caveats(indexed, dirty, indexed_head, head), lambda c: F.when(c == "booting", words["booting"]).otherwise(words["lagging"]))
    own = F.trim(persona)
    parts = F.array(
        F.when(persona_usable(resolved, tools, indexed, failed, tool) & (own != ""), own),
        F.when(asked, F.when(strong, "locate first, then read the best result").otherwise(share)),
    )
    return F.array_compact(F.concat(parts, F.when(asked, caveats).otherwise(F.array().cast("array<string>"))))


def sub_command(args: Column) -> Column:
    """struct(sub, path): status, stats or reindex; only reindex has a path, and an unknown word means status."""
    tokens = white_space_tokens(F.coalesce(args, F.lit("")))
    first = F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))
    sub = F.when(first.isin("reindex", "stats"), first).otherwise("status")
    path = F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), " ")
    return F.struct(sub.alias("sub"), F.when((sub == "reindex") & (path != ""), path).alias("path"))


# ---- shell commands ------------------------------------------------------------------------------
_PIECE = re.compile(r"'[^']*(?:'|$)|\"[^\"]*(?:\"|$)|&&|\|\||[;|\n]|\$\(|`[^`]*(?:`|$)|[^'\"&|;\n$`]+|.", re.DOTALL)
_SEARCHES = (
    ("git-grep", r"git\s+grep"), ("rg", "rg"), ("grep", "[ef]?grep"), ("fd", "fd(?:find)?"), ("ag", "ag"), ("ack", "ack"), ("find", "find"),
)
_SEARCH = [(tool, re.compile(rf"\s*{head}\s+(\S.*)$")) for tool, head in _SEARCHES]
_ARGUMENT = re.compile(r"'[^']*'|\"[^\"]*\"|\S+")


def shell_segments(command: str, substitutions: bool = False) -> list[tuple[str, bool]]:
    """(text, fed by a pipe) of each simple command; bodies of substitutions are lifted out if asked for."""
    out: list[tuple[str, bool]] = []
    text, piped, at = "", False, 0
    while at < len(command):
        m = _PIECE.match(command, at)
        piece, at = m[0], m.end()
        if substitutions and (piece == "$(" or piece[0] == "`"):
            if piece == "$(":
                start, depth = at, 1
                while at < len(command) and depth:
                    depth += {"(": 1, ")": -1}.get(command[at], 0)
                    at += 1
                inner = command[start : at - 1 if depth == 0 else at]
            else:
                inner = piece.strip("`")
            out.extend(shell_segments(inner, True))
        elif piece in ("&&", "||", ";", "|", "\n"):
            if text.strip():
                out.append((text, piped))
            text, piped = "", piece == "|"
        else:
            text += piece
    return [*out, (text, piped)] if text.strip() else out


def _bare(argument: str) -> str:
    return re.sub(r"^['\"]|['\"]$", "", argument)


def detect_search(command: str | None) -> tuple[str, str] | None:
    """(tool, pattern) of the first search that is no filter of a pipe."""
    for text, piped in shell_segments(command or ""):
        for tool, pattern in () if piped else _SEARCH:
            m = pattern.match(text)
            if not m:
                continue
            args = _ARGUMENT.findall(m[1])
            if tool == "find":
                named = [b for a, b in zip(args, args[1:]) if a in ("-name", "-iname", "-path")]
            else:
                named = [a for a in args if not a.startswith("-")]
            if named:
                return tool, _bare(named[0])
    return None


def classify_grep(command: str | None, is_dir: Callable[[str], bool]) -> tuple[bool, str | None]:
    """(scans a directory tree, kind of pattern) of the first such grep in a command."""
    for text, _ in shell_segments(command or "", True):
        head, *rest = text.split()
        if not re.fullmatch("[ef]?grep", head) or {"--help", "--version", "-V"} & set(rest):
            continue
        words, recursive = [], False
        given, args = None, iter(rest)
        for arg in args:
            if arg in ("-e", "--regexp"):
                value = next(args, None)
                given = value if given is None and not words else given
            elif arg.startswith("-"):
                recursive |= arg == "--recursive" or bool(re.fullmatch("-[a-zA-Z]*[rR][a-zA-Z]*", arg))
            else:
                words.append(arg)
        if given is None and words:
            given, words = words[0], words[1:]
        strip = lambda t: t[1:-1] if len(t) > 1 and t[0] in "'\"" and t[-1] == t[0] else t
        if any(is_dir(strip(p)) for p in words) or (recursive and not words):
            symbol = given is not None and re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", strip(given))
            return True, "symbol" if symbol else "regex"
    return False, None


def guard_action(scans: Column, active: Column, rg_available: Column) -> Column:
    """allow, warn (allowed for want of a faster tool) or block."""
    return F.when(~scans | ~active, "allow").when(~rg_available, "warn").otherwise("block")


def with_searches(df: DataFrame, command: str = "command") -> DataFrame:
    """Adds ``search``: struct(tool, pattern), null where a command does not search."""

    @F.pandas_udf(T.StructType([T.StructField("tool", T.StringType()), T.StructField("pattern", T.StringType())]))
    def find(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect_search(v) or (None, None) for v in values], columns=["tool", "pattern"])

    found = find(F.col(command))
    return df.withColumn("__s", found).withColumn("search", F.when(F.col("__s.tool").isNotNull(), F.col("__s"))).drop("__s")


def with_grep_class(df: DataFrame, directories: Iterable[str], command: str = "command") -> DataFrame:
    """Adds ``grep``: struct(scans, kind), with the directories that exist given as a set."""
    known = frozenset(directories)

    @F.pandas_udf(T.StructType([T.StructField("scans", T.BooleanType()), T.StructField("kind", T.StringType())]))
    def judge(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify_grep(v, lambda p: p.rstrip("/") in known) for v in values], columns=["scans", "kind"])

    return df.withColumn("grep", judge(F.col(command)))
