"""Symbols, imports and text of source files: Python by its own parser, Ruby, TypeScript and JavaScript by a lexer.

Lines are 0-based and bounds included; bytes are offsets into the UTF-8 text. Broken sources give what can be read.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.functions.text import keywords, prose_tokens, stoplist

SYMBOLS = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("start_byte", T.IntegerType()), T.StructField("end_byte", T.IntegerType()),
]))
IMPORTS = T.ArrayType(T.StructType([T.StructField("hint", T.StringType()), T.StructField("kind", T.StringType())]))
TEXTS = T.ArrayType(T.StringType())

_SCRIPT_LEX = re.compile(r"//[^\n]*|/\*.*?(?:\*/|$)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?", re.DOTALL)
_RUBY_LEX = re.compile(r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)|#[^\n]*|'(?:\\.|[^'\\])*'?|\"(?:\\.|[^\"\\])*\"?", re.DOTALL | re.MULTILINE)
_NAME = r"[A-Za-z_$][\w$]*"


def _blanked(source: str, lexer: re.Pattern) -> tuple[str, list[tuple[int, str]]]:
    """The source with comments and strings as blanks of equal length, and those pieces with their places."""
    pieces = [(m.start(), m[0]) for m in lexer.finditer(source)]
    return lexer.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source), pieces


class _Places:
    def __init__(self, source: str):
        self.source = source
        self.starts = [0] + [m.end() for m in re.finditer("\n", source)]

    def symbol(self, name: str, kind: str, start: int, end: int) -> dict:
        from bisect import bisect_right

        line = lambda i: bisect_right(self.starts, i) - 1
        size = lambda i: len(self.source[:i].encode("utf-8", "surrogatepass"))
        return {"name": name, "kind": kind, "start_line": line(start), "end_line": line(max(start, end - 1)), "start_byte": size(start), "end_byte": size(end)}


def _closing(text: str, at: int, pair: str = "{}") -> int:
    """The place behind the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(text)


def _script_symbols(source: str) -> list[dict]:
    text, _ = _blanked(source, _SCRIPT_LEX)
    at, found, bodies = _Places(source), [], []
    for m in re.finditer(rf"\b(class|function)\b\s*\*?\s*({_NAME})", text):
        if m[1] == "class":
            brace = text.find("{", m.end())
        else:
            paren = text.find("(", m.end())
            brace = text.find("{", _closing(text, paren, "()")) if paren >= 0 else -1
        end = _closing(text, brace) if brace >= 0 else m.end()
        found.append((m.start(), end, m[2], m[1]))
        if m[1] == "class" and brace >= 0:
            bodies.append((brace + 1, end - 1))
    for lo, hi in bodies:
        i = lo
        pattern = re.compile(rf"(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?\s*(#?{_NAME})\s*(?:<[^<>(){{}}]*>)?\(")
        while i < hi:
            m = pattern.match(text, i)
            if m and (i == lo or text[i - 1] in "{};\n \t"):
                close = _closing(text, m.end() - 1, "()")
                tail = re.compile(r"\s*(?::[^{};=]+)?\{").match(text, close)
                if tail and m[1] not in ("if", "for", "while", "switch", "catch", "function"):
                    end = _closing(text, tail.end() - 1)
                    found.append((m.start() + len(m[0]) - len(m[0].lstrip()), end, m[1], "method"))
                    i = end
                    continue
            i = _closing(text, i) if text[i] == "{" else i + (len(w[0]) if (w := re.compile(r"[\w$]+").match(text, i)) else 1)
    for m in re.finditer(r"\bconst\s+(?!enum\b)", text):
        i = m.end()
        while name := re.compile(rf"\s*({_NAME})\s*(?::[^=;,]+)?").match(text, i):
            j, depth = name.end(), 0
            while j < len(text) and not (depth == 0 and text[j] in ",;\n" and not (text[j] == "\n" and text[name.end() : j].strip() in ("", "="))):
                depth += (text[j] in "([{") - (text[j] in ")]}")
                if depth < 0:
                    break
                j += 1
            start = name.start(1)
            found.append((start, len(text[:j].rstrip()), name[1], "const"))
            if j >= len(text) or text[j] != ",":
                break
            i = j + 1
    return [at.symbol(n, k, s, e) for s, e, n, k in sorted(found, key=lambda x: (x[0], -x[1]))]


_RUBY_WORD = re.compile(r"(?P<open>\b(?:class|module|def|do|begin|case|if|unless|while|until|for)\b)|(?P<end>\bend\b)")


def _ruby_symbols(source: str) -> list[dict]:
    text, _ = _blanked(source, _RUBY_LEX)
    at, found, stack = _Places(source), [], []
    for m in _RUBY_WORD.finditer(text):
        word = m[0]
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if text[m.start() - 1 : m.start()] in (":", ".", "@") or text[m.end() : m.end() + 1] in (":", "?"):
            continue
        if word == "end":
            if stack:
                start, name, kind = stack.pop()
                if name:
                    found.append((start, m.end(), name, kind))
            continue
        if word in ("if", "unless", "while", "until") and line.strip() and not re.search(r"(=|\(|\bthen|;)\s*$", line):
            continue  # a trailing condition opens no block
        if word == "do" and re.match(r"\s*(while|until|for)\b", line):
            continue
        name = None
        if word in ("class", "module"):
            named = re.compile(r"\s+([A-Z][\w:]*)").match(text, m.end())
            name = named[1] if named else None
        elif word == "def":
            named = re.compile(r"\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)").match(text, m.end())
            name = named[1] if named else None
        stack.append((m.start(), name, {"class": "class", "module": "module", "def": "method"}.get(word, "")))
    found += [(s, len(source), n, k) for s, n, k in stack if n]
    return [at.symbol(n, k, s, e) for s, e, n, k in sorted(found, key=lambda x: (x[0], -x[1]))]


def _python_symbols(source: str) -> list[dict]:
    lines = source.encode("utf-8", "surrogatepass").split(b"\n")
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line) + 1)
    out = []

    def walk(node: ast.AST) -> None:
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append({
                "name": node.name, "kind": "class" if isinstance(node, ast.ClassDef) else "function", "start_line": node.lineno - 1,
                "end_line": node.end_lineno - 1, "start_byte": offsets[node.lineno - 1] + node.col_offset,
                "end_byte": offsets[node.end_lineno - 1] + node.end_col_offset,
            })
        for child in ast.iter_child_nodes(node):
            walk(child)

    try:
        walk(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError):
        at = _Places(source)
        return [at.symbol(m[2], "class" if m[1] == "class" else "function", m.start(1), m.end()) for m in re.finditer(r"^[ \t]*(class|def)\s+(\w+)", source, re.MULTILINE)]
    return out


def extract_symbols(lang: str | None, source: str | None) -> list[dict]:
    reader = {"python": _python_symbols, "ruby": _ruby_symbols, "ts": _script_symbols, "js": _script_symbols}.get(lang or "")
    return reader(source) if reader and source else []


def extract_imports(lang: str | None, source: str | None) -> list[dict]:
    """Hints and kinds in order; the dots of a relative Python import are lost, aliased plain imports give none."""
    source = source or ""
    out: list[tuple[int, str, str]] = []
    if lang == "python":
        for m in re.finditer(r"^[ \t]*(?:from[ \t]+(\.*)[ \t]*([\w.]*)[ \t]+import\b|import[ \t]+([^\n#;]+))", source, re.MULTILINE):
            if m[3]:
                out += [(m.start(), p.strip(), "import") for p in m[3].split(",") if re.fullmatch(r"[\w.]+", p.strip())]
            else:
                out.append((m.start(), m[2] or ".", "import"))
    elif lang == "ruby":
        blank, _ = _blanked(source, _RUBY_LEX)
        for m in re.finditer(r"\b(require|require_relative)\b[ \t(]*", blank):
            s = re.compile(r"['\"]([^'\"]+)['\"]").match(source, m.end())
            if s is None and (s := re.compile(r"[ \t(]*['\"]([^'\"]+)['\"]").match(source, m.start() + len(m[1]))) is None:
                continue
            out.append((m.start(), s[1], m[1]))
        out += [(m.start(), m[0], "ruby_const") for m in re.finditer(r"(?<![\w:@$.])[A-Z]\w*(?:::[A-Z]\w*)*", blank)]
    elif lang in ("ts", "js"):
        blank, pieces = _blanked(source, _SCRIPT_LEX)
        for start, text in pieces:
            before = blank[:start].rstrip()
            if text[0] not in "'\"`":
                continue
            if re.search(r"\brequire\s*\($", before) and text[0] != "`":
                out.append((start, text.strip("'\""), "require"))
            elif re.search(r"(?:^|[;\n}])\s*import(?:\s+type)?(?:\s*$|\s[^;'\"]*\bfrom$)", before) and text[0] != "`":
                out.append((start, text.strip("'\""), "import"))
    return [{"hint": h, "kind": k} for _, h, k in sorted(out, key=lambda x: x[0])]


def extract_text(lang: str | None, source: str | None) -> list[str]:
    """The comments and string literals, as written."""
    source = source or ""
    if lang == "python":
        out: list[str] = []
        depth, start = 0, (0, 0)
        lines = source.split("\n")
        try:
            for t in tokenize.generate_tokens(io.StringIO(source).readline):
                name = tokenize.tok_name[t.type]
                if name == "FSTRING_START":
                    start = t.start if depth == 0 else start
                    depth += 1
                elif name == "FSTRING_END":
                    depth -= 1
                    if depth == 0:
                        (a, b), (c, d) = start, t.end
                        out.append(lines[a - 1][b:d] if a == c else "\n".join([lines[a - 1][b:], *lines[a : c - 1], lines[c - 1][:d]]))
                elif depth == 0 and name in ("COMMENT", "STRING"):
                    out.append(t.string)
        except (tokenize.TokenError, SyntaxError):
            pass
        return out
    lexer = {"ruby": _RUBY_LEX, "ts": _SCRIPT_LEX, "js": _SCRIPT_LEX}.get(lang or "")
    return [m[0] for m in lexer.finditer(source)] if lexer else []


def with_extracted(files: DataFrame) -> DataFrame:
    """files(path, lang, text, ...) with arrays symbols, imports and texts."""

    @F.pandas_udf(SYMBOLS)
    def symbols(lang: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([extract_symbols(a, b) for a, b in zip(lang, text)])

    @F.pandas_udf(IMPORTS)
    def imports(lang: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([extract_imports(a, b) for a, b in zip(lang, text)])

    @F.pandas_udf(TEXTS)
    def texts(lang: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([extract_text(a, b) for a, b in zip(lang, text)])

    args = F.col("lang"), F.col("text")
    return files.withColumns({"symbols": symbols(*args), "imports": imports(*args), "texts": texts(*args)})


def index_columns(extra_stop: tuple[str, ...] = ()) -> dict[str, Column]:
    """The text fields of the full-text index, symbol_names, keywords and content, for rows of ``with_extracted``."""
    prose = F.array_join(prose_tokens(F.coalesce("text", F.lit("")), stoplist("prose", extra_stop)), " ")
    names = F.transform("symbols", lambda s: s["name"])
    words = F.concat(names, F.flatten(F.transform("texts", lambda t: F.split(t, "\\s+"))))
    kept = F.lit("")
    for lang in ("ruby", "python", "ts", "js"):
        kept = F.when(F.col("lang") == lang, F.array_join(keywords(words, stoplist(lang, extra_stop)), " ")).otherwise(kept)
    content = F.array_join(keywords(F.flatten(F.transform("texts", lambda t: F.split(t, "\\s+"))), [], 1), " ")
    is_prose = F.col("lang") == "prose"
    return {
        "symbol_names": F.when(is_prose, "").otherwise(F.array_join(names, " ")), "keywords": F.when(is_prose, prose).otherwise(kept),
        "content": F.when(is_prose, prose).otherwise(content),
    }


def index_rows(extracted: DataFrame, extra_stop: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, path, symbol_names, keywords, content): the text fields of the full-text index.

    Prose has no symbol names and the same tokens twice; code has filtered keywords of its names, comments and strings
    and their unfiltered parts. Files without a language are not indexed.
    """
    made = [column.alias(name) for name, column in index_columns(extra_stop).items()]
    return extracted.where("lang is not null").select("file_id", "path", *made)
