"""The Porter stemmer (M. F. Porter, 1980), for use on distinct terms only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published algorithm: suffixes and their replacements, by step.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and not (c == "y" and i > 0 and out[-1]))
    return out


def measure(word: str) -> int:
    """The number of vowel-consonant sequences."""
    kinds = _consonants(word)
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def _short_end(word: str) -> bool:
    k = _consonants(word)
    return len(word) > 2 and k[-1] and not k[-2] and k[-3] and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            return root + table[suffix] if measure(root) > least else word
    return word


def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and not all(_consonants(word[:-2])):
        cut = word[:-2]
    elif word.endswith("ing") and not all(_consonants(word[:-3])):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double_end(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and not all(_consonants(word[:-1])):
        word = word[:-1] + "i"
    word = _replace(word, STEP2, 0)
    word = _replace(word, STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            if measure(root) > 1 and (suffix != "ion" or root.endswith(("s", "t"))):
                word = root
            break
    if word.endswith("e"):
        root = word[:-1]
        if measure(root) > 1 or (measure(root) == 1 and not _short_end(root)):
            word = root
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stem_terms(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else porter(t))


def stemmed(term: Column) -> Column:
    return stem_terms(term)
