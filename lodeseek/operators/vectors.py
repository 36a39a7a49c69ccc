"""Vector tables: exact top-k under L2 or cosine, filters, upsert and delete, and cells that prune an L2 search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_l2(vector: Column, query: Sequence[float]) -> Column:
    """Folded over the zipped arrays in DOUBLE, in the order of the dimensions."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def dot(vector: Column, query: Sequence[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """0 where either vector is zero."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = float(np.sqrt(sum(float(x) * float(x) for x in query)))
    return F.when(size * own == 0, F.lit(0.0)).otherwise(dot(vector, query) / (size * own))


def matches(filters: dict[str, object]) -> Column:
    """Conjunction of equalities; values of other types than text, number and boolean are ignored."""
    out = F.lit(True)
    for name, value in filters.items():
        if isinstance(value, (str, int, float, bool)):
            out = out & (F.col(name) == F.lit(value))
    return out


def top_k(
    vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "l2", filters: dict[str, object] | None = None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, score): score is 1 - squared distance (may be negative) or the cosine; filters apply before the cut and reach the scan."""
    rows = vectors.where(matches(filters)) if filters else vectors
    score = 1 - squared_l2(F.col(vector_col), query) if metric == "l2" else cosine(F.col(vector_col), query)
    return rows.select(F.col(id_col).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def collection_stats(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    size = F.coalesce(F.max(F.size(vector_col)), F.lit(0))
    return vectors.agg(F.count("*").alias("vector_count"), size.cast("long").alias("dimension"), (F.count("*") * size * 4).alias("index_size"))


def upsert(current: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """New rows replace those of their ids. Of new rows with one id the caller's order is unknown to Spark, so keep one beforehand."""
    return current.join(new.select(id_col).distinct(), id_col, "left_anti").unionByName(new)


def delete(current: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return current.join(ids.select(id_col).distinct(), id_col, "left_anti")


def fit_cells(vectors: DataFrame, cells: int = 64, sample_rows: int = 20_000, rounds: int = 12, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Centroids by Lloyd's rounds on a bounded sample (the rows of the smallest id hashes, at most sample_rows)."""
    rows = vectors.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(sample_rows).select(vector_col).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    rng = np.random.RandomState(seed)
    centers = x[rng.permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        near = ((x[:, None, :] - centers[None]) ** 2).sum(2).argmin(1) if len(x) * len(centers) < 2_000_000 else (-2 * x @ centers.T + (centers**2).sum(1)).argmin(1)
        for c in range(len(centers)):
            if (near == c).any():
                centers[c] = x[near == c].mean(0)
    return centers


def with_cell(vectors: DataFrame, centers: np.ndarray, vector_col: str = "embedding", cell_col: str = "cell_id") -> DataFrame:
    """Each row's nearest centroid, to partition a table by (partitionBy(cell_col)): a search then reads few partitions."""
    distances = F.array(*(F.struct(squared_l2(F.col(vector_col), c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centers.tolist())))
    return vectors.withColumn(cell_col, F.array_min(distances)["c"])


def top_k_in_cells(
    vectors: DataFrame, centers: np.ndarray, query: Sequence[float], k: int = 10, probes: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", cell_col: str = "cell_id"
) -> DataFrame:
    """Approximate L2 top-k over the cells nearest to the query; with as many probes as cells it is exact."""
    near = ((centers - np.array(query)) ** 2).sum(1).argsort()[:probes].tolist()
    return top_k(vectors.where(F.col(cell_col).isin(*near)), query, k, id_col=id_col, vector_col=vector_col)
