"""Tokenisation as column expressions: identifiers, keywords, prose, and query tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search, by language and for all of them.
_SCRIPT = (
    "function const let var return if else for while in of new this null undefined true false import export "
    "from as default class extends async await typeof instanceof"
)
STOPWORDS = {
    "ruby": (
        "def end class module if unless else elsif when case do yield self nil true false return require include "
        "extend attr_accessor attr_reader begin rescue ensure raise next break super freeze new"
    ).split(),
    "python": (
        "def class return if elif else for while in is not and or import from as with assert pass lambda yield self "
        "none true false raise try except finally del print len str int list dict"
    ).split(),
    "ts": _SCRIPT.split(),
    "js": _SCRIPT.split(),
    "prose": [],
}
SHARED_STOPWORDS = (
    "todo fixme xxx hack note deprecated tmp temp foo bar baz qux "
    "the a an and or of to in is it for on with as at by be this that not from"
).split()
MIN_LENGTH = 3
_SCHEME = "^(?i)[a-z]+://"
#: Fixed value: what running text loses before it is cut.
URL = r"(?i)[a-z][a-z0-9+\-.]*://\S*"


def stoplist(lang: str | None = None, extra: Iterable[str] = ()) -> list[str]:
    """The union of the language's, the shared and the user's stop words."""
    return sorted({*STOPWORDS.get(lang or "", []), *SHARED_STOPWORDS, *(w.lower() for w in extra)})


def white_space_tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), "\\s+"), lambda t: t != "")


def split_identifier(name: Column) -> Column:
    """Lower-case parts at case changes, acronyms and anything but ASCII letters and digits."""
    cut = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    cut = F.regexp_replace(cut, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda t: t != "")


def is_junk(token: Column, min_length: int = MIN_LENGTH) -> Column:
    """Short, all digits, six or more hex digits, or a URL."""
    return (F.length(token) < min_length) | token.rlike("^[0-9]+$") | token.rlike("^(?i)[0-9a-f]{6,}$") | token.rlike(_SCHEME)


def _useful(tokens: Column, stop: list[str], min_length: int) -> Column:
    words = F.lit(stop)
    return F.array_distinct(F.filter(tokens, lambda t: ~is_junk(t, min_length) & ~F.array_contains(words, t)))


def keywords(raw: Column, stop: list[str], min_length: int = MIN_LENGTH) -> Column:
    """Keywords of an array of raw tokens: URLs skipped, identifiers split, junk and stop words out, first ones kept."""
    plain = F.filter(raw, lambda t: ~t.rlike(_SCHEME))
    return _useful(F.flatten(F.transform(plain, split_identifier)), stop, min_length)


def prose_tokens(text: Column, stop: list[str], min_length: int = MIN_LENGTH) -> Column:
    """Distinct tokens of running text in order of first use; all but ASCII letters, digits and _ separate."""
    bare = F.regexp_replace(text, URL, " ")
    return _useful(F.split(F.lower(bare), "[^a-z0-9_]+"), stop, min_length)


def raw_prose_tokens(text: Column) -> Column:
    """Distinct tokens of running text before junk and stop words are taken out."""
    return F.array_distinct(F.split(F.lower(F.regexp_replace(text, URL, " ")), "[^a-z0-9_]+"))


def underscore_constant(name: Column) -> Column:
    """The path stem of a constant: ``Billing::InvoiceItem`` becomes ``billing/invoice_item``."""
    path = F.regexp_replace(name, "::", "/")
    path = F.regexp_replace(path, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(path, "([a-z0-9])([A-Z])", "$1_$2"))


def identifier_like(token: Column) -> Column:
    return token.rlike("_|[0-9]|[a-z][A-Z]")


def index_terms(text: Column) -> Column:
    """Terms of the full-text index: runs of letters and digits, lower-cased, without diacritics of Latin letters."""
    return F.filter(F.split(fold(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


#: Latin letters with marks, and the letters they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)
