"""Ranking signals as column expressions: path, symbol, recency, fusion, penalty, confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking.
FIELD_WEIGHTS = {"path": 4.0, "symbol_names": 3.0, "keywords": 2.0, "content": 0.5}
K1, B0, LEAST_IDF = 1.2, 0.75, 1e-6
TEST_PENALTY, CANDIDATES, NEIGHBOURS, REFERRERS, HUB_SHARE = 0.5, 200, 5, 10, 0.2
DAY = 86_400
TEST_PATH = r"(?:^|/)spec/|(?:^|/)tests?/|_spec\.[a-z]+$|_test\.[a-z]+$|\.(?:test|spec)\.[tj]sx?$|(?:^|/)test_[^/]+$"


@dataclass(frozen=True)
class Weights:
    fts: float = 1.0
    path: float = 3.5
    symbol: float = 2.0
    recency: float = 0.5


def stem_of(path: Column) -> Column:
    """The last segment without its last extension (a leading dot is no extension)."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def path_match(tokens: Column, path: Column) -> Column:
    """1 if a token is the file's stem, else 0.5 if one lies within a segment, else 0."""
    lower = F.lower(path)
    parts = F.filter(F.split(lower, "/"), lambda s: s != "")
    exact = F.exists(tokens, lambda t: F.lower(t) == stem_of(lower))
    within = F.exists(tokens, lambda t: F.exists(parts, lambda s: s.contains(F.lower(t))))
    return F.when(F.coalesce(exact, F.lit(False)), 1.0).when(F.coalesce(within, F.lit(False)), 0.5).otherwise(0.0)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def recency_boost(commits_30d: Column, last_commit_at: Column, now: int) -> Column:
    """Mean of the recent commit count (ten at most) and a 90-day decay of the age; both lacking gives 0."""
    busy = F.least(F.coalesce(commits_30d, F.lit(0)), F.lit(10)) / F.lit(10.0)
    age = F.greatest(F.lit(0.0), (F.lit(now) - last_commit_at) / F.lit(float(DAY)))
    # greatest() skips nulls, so a missing time is tested by itself.
    return (busy + F.when(last_commit_at.isNull(), 0.0).otherwise(F.exp(-age / 90.0))) / 2.0


def fused_score(fts: Column, path: Column, symbol: Column, recency: Column, weights: Weights = Weights()) -> Column:
    return weights.fts * fts + weights.path * path + weights.symbol * symbol + weights.recency * recency


def penalised(score: Column, path: Column, penalty: float = TEST_PENALTY) -> Column:
    return F.when(is_test_path(path), score * penalty).otherwise(score)


def confidence(has_exact_def: Column, used_or: Column, n_tokens: Column, top_has_anchor: Column) -> Column:
    weak = (used_or & (n_tokens >= 2)) | ~top_has_anchor
    return F.when(has_exact_def, "high").when(weak, "low").otherwise("high")


def strong_hit(n_results: Column, has_exact_def: Column, top_has_anchor: Column) -> Column:
    return (n_results > 0) & has_exact_def & top_has_anchor


def bm25_term(tf: Column, length: Column, mean_length: Column, n_docs: Column, df: Column) -> Column:
    """The (positive) contribution of one phrase; a phrase in half of the rows or more counts next to nothing."""
    idf = F.log((n_docs - df + 0.5) / (df + 0.5))
    idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
    return idf * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B0 + B0 * length / mean_length))
