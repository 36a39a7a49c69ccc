"""Hybrid ranking: keyword and vector arms, min-max normalised over their union and mixed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ALPHA = 0.3


@dataclass(frozen=True)
class Mix:
    """alpha weighs the keyword arm and lies in [0, 1]."""

    alpha: float = DEFAULT_ALPHA

    def __post_init__(self) -> None:
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be between 0 and 1")


def min_max(scores: DataFrame, score_col: str = "score", out_col: str = "norm") -> DataFrame:
    """Rescales to [0, 1]; all equal (or a single row) becomes 1. The extremes are one row, joined, not a global window."""
    ends = scores.agg(F.min(score_col).alias("_lo"), F.max(score_col).alias("_hi"))
    value = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col(score_col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return scores.crossJoin(F.broadcast(ends)).withColumn(out_col, value).drop("_lo", "_hi")


def merge(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, bm25, vec): full outer on id, a missing side counts 0."""
    joined = keyword.select("id", F.col("score").alias("bm25")).join(vector.select("id", F.col("score").alias("vec")), "id", "full_outer")
    return joined.select("id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("vec", F.lit(0.0)).alias("vec"))


def mix(merged: DataFrame, how: Mix = Mix()) -> DataFrame:
    """(id, bm25, vec, score): each arm is normalised over the union, zeros included. merged has at most 2 x 2k rows, so one window serves both arms."""
    both = Window.partitionBy()

    def norm(name: str):
        lo, hi = F.min(name).over(both), F.max(name).over(both)
        return F.when(hi == lo, F.lit(1.0)).otherwise((F.col(name) - lo) / (hi - lo))

    scored = merged.withColumn("_b", norm("bm25")).withColumn("_v", norm("vec"))
    return scored.select("id", "bm25", "vec", (how.alpha * F.col("_b") + (1 - how.alpha) * F.col("_v")).alias("score"))


@dataclass(frozen=True)
class Filter:
    """Conjunction of: file types (an extension's dot is optional), languages, a substring of the path."""

    file_types: Sequence[str] | None = None
    languages: Sequence[str] | None = None
    path: str | None = None
    ignore_case: bool = False

    def apply(self, hits: DataFrame, file_type_col: str = "file_type", language_col: str = "language", path_col: str = "id") -> DataFrame:
        if self.file_types:
            hits = hits.where(F.regexp_replace(file_type_col, r"^\.", "").isin(*(t.removeprefix(".") for t in self.file_types)))
        if self.languages:
            own = F.lower(language_col) if self.ignore_case else F.col(language_col)
            hits = hits.where(own.isin(*(x.lower() if self.ignore_case else x for x in self.languages)))
        if self.path:
            hits = hits.where(F.col(path_col).cast("string").contains(self.path))
        return hits


def rank(hits: DataFrame, k: int | None = None) -> DataFrame:
    ordered = hits.orderBy(F.desc("score"), "id")
    return ordered if k is None else ordered.limit(k)


def search(
    keyword: DataFrame, vector: DataFrame, k: int = 10, how: Mix = Mix(), metadata: DataFrame | None = None, where: Filter | None = None, prefilter: bool = False
) -> DataFrame:
    """Both arms' best 2k (id, score) merged, normalised and mixed; then the filter, then the k best.

    metadata (id, language, file_type) is joined to the few hits before the filter. With prefilter the arms are
    filtered first, so that k results are found whenever there are that many."""
    if prefilter and where is not None and metadata is not None:
        keyword, vector = (where.apply(arm.join(metadata, "id")).select("id", "score") for arm in (keyword, vector))
    hits = mix(merge(rank(keyword, 2 * k), rank(vector, 2 * k)), how)
    if metadata is not None:
        hits = hits.join(metadata, "id", "left")
    if where is not None:
        hits = where.apply(hits)
    return rank(hits, k)
