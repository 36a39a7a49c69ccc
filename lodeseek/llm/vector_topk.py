"""Exact top-k by inner product, term at a time.

A vector is a sparse row of integer weights, floor(scale * x) of its components; a component is a term, and a block of
candidates keeps for each term its postings (places and weights other than zero). Query rows scatter weighted postings
into dense arrays of scores, one term after the other; partition selection takes the best of a block, which are
merged with what the query has so far.

Queries and candidates are dealt to the cells of a grid: a query group (bounded by ``group_bytes``) and a candidate
group meet in one cell. Candidates stream through their cell, so a task holds a query group, its best so far and one
block. Cells return k rows a query, merged by a window. Groups come from hashes of row contents and numbers, so
no group is hot, however often a vector is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.session import materialize

SCALE = 1024
BLOCK = 2048
QUERIES_AT_ONCE = 64
GROUP_BYTES = 32 << 20
EXACT_DOUBLE = 2.0**53
LARGEST = 2**63 - 1


@dataclass
class Postings:
    """A block of candidates by term: for each the places that hold it, None for all, and their weights."""

    terms: list[tuple[np.ndarray | None, np.ndarray]]
    rows: int


def postings_of(block: np.ndarray) -> Postings:
    terms = []
    for column in block.T:
        at = np.flatnonzero(column)
        terms.append((None, np.ascontiguousarray(column)) if len(at) == len(column) else (at, column[at]))
    return Postings(terms, len(block))


def accumulate(queries: np.ndarray, postings: Postings) -> np.ndarray:
    """Scores of each query row against each candidate of the block, a term at a time."""
    scores = np.zeros((len(queries), postings.rows), dtype=queries.dtype)
    for term, (at, weights) in enumerate(postings.terms):
        having = np.flatnonzero(queries[:, term])
        if not len(having) or not len(weights):
            continue
        parts = queries[having, term][:, None] * weights
        if at is None and len(having) == len(queries):
            scores += parts
        elif at is None:
            scores[having] += parts
        else:
            scores[having[:, None], at] += parts
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row the k best (scores, ids), ties to smaller ids. ids ascend; own: the id that a row leaves out."""
    out = []
    for row, mine in zip(scores, own):
        allowed = np.flatnonzero(ids != mine)
        values = row[allowed]
        if len(values) > k:
            least = np.partition(values, len(values) - k)[len(values) - k]
            above = np.flatnonzero(values > least)
            # ids ascend, so the first of those that tie are the smallest
            values_at = np.concatenate([above, np.flatnonzero(values == least)[: k - len(above)]])
            allowed, values = allowed[values_at], values[values_at]
        out.append((values, ids[allowed]))
    return out


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    values, ids = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(ids, kind="stable")
    values, ids = values[order], ids[order]
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], ids[order]


def exact_type(*largest: float, width: int) -> type:
    """Doubles where every sum is exact in them, else Python's integers."""
    return np.float64 if largest[0] * largest[1] * max(width, 1) < EXACT_DOUBLE else object


def as_matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    if all(len(r) == width for r in rows):
        return np.stack(rows)
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def integers(values: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, dtype=object)
    out[...] = [[int(x) for x in row] for row in values.tolist()]
    return out


def best_of_block(queries: np.ndarray, own: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(ids, kind="stable")
    block, ids = block[order], ids[order]
    kind = exact_type(*(float(np.abs(x).max(initial=0)) for x in (queries, block)), width=block.shape[1])
    if kind is object:
        queries, block = integers(queries), integers(block)
    postings = postings_of(block)
    out = []
    for lo in range(0, len(queries), QUERIES_AT_ONCE):
        part = slice(lo, lo + QUERIES_AT_ONCE)
        scores = accumulate(queries[part], postings)
        if kind is object:
            scores = np.clip(scores, -LARGEST, LARGEST)
        out += select(scores.astype(np.int64), ids, own[part], k)
    return out


def rounded(vector: Column, scale: int) -> Column:
    """The vector's whole weights as doubles (exact: scale is a power of two); null for vectors that take no part."""
    weights = F.transform(vector, lambda x: _floor(x.cast("double") * scale))
    bad = F.exists(weights, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, weights)


def _floor(x: Column) -> Column:
    """Doubles of 2^52 or more are whole; Spark's floor would squeeze them into a long."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(x).cast("double"))


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, group_bytes: int = GROUP_BYTES, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): for each query the k candidates of the largest inner product, ties to the smaller id.

    Vectors that are null, or hold a null or non-finite component, and rows without an id take no part. An empty vector scores
    0; of vectors of different lengths the shorter one lacks the other's terms. Candidates of the query's own id are left out.
    A repeated row is a candidate each time; queries that repeat an id are one, its greatest vector. Sums beyond doubles are
    done in whole numbers, and scores beyond a long count as the nearest long. No queries or no candidates: no rows.
    Other columns, whatever their names, are not read. scale is a power of two."""
    spark = candidates.sparkSession

    def taken(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), rounded(F.col(vector_col), scale).alias("v"))
        return rows.where("id IS NOT NULL AND v IS NOT NULL")

    asked = materialize(taken(queries).groupBy("id").agg(F.max("v").alias("v")), "topk")
    rows = taken(candidates)
    size = F.sum(F.size("v") * 8 + 16).alias("bytes")
    q_bytes, c_bytes = (df.agg(size).first()[0] or 0 for df in (asked, rows))
    q_groups = max(1, -(-q_bytes // group_bytes))
    c_groups = max(1, spark.sparkContext.defaultParallelism // q_groups, -(-c_bytes // group_bytes))
    dealt = [
        (asked, 0, F.pmod(F.xxhash64("id"), F.lit(q_groups)), F.sequence(F.lit(0), F.lit(c_groups - 1)), True),
        (rows, 1, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(c_groups)), F.sequence(F.lit(0), F.lit(q_groups - 1)), False),
    ]
    sides = None
    for df, kind, own, other, is_query in dealt:
        df = df.select("id", "v", own.cast("int").alias("own"), F.explode(other).alias("other"))
        q, c = ("own", "other") if is_query else ("other", "own")
        df = df.select((F.col(q) * c_groups + F.col(c)).alias("cell"), F.lit(kind).alias("kind"), "id", "v")
        sides = df if sides is None else sides.unionByName(df)
    cells = sides.repartitionById(q_groups * c_groups, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own, vectors, best, matrix = None, [], [], [], None

        def result() -> pa.RecordBatch:
            queries = np.repeat(np.array(own, dtype=np.int64), [len(v) for v, _ in best])
            scores, ids = (np.concatenate([b[i] for b in best]).astype(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(ids), pa.array(scores)], names=["query_id", "id", "score"])

        for batch in batches:
            cell_of, kind_of, ids = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            breaks = np.flatnonzero((np.diff(cell_of) != 0) | (np.diff(kind_of) != 0)) + 1
            for lo, hi in zip([0, *breaks], [*breaks, len(ids)]):
                if cell_of[lo] != cell:
                    if best:
                        yield result()
                    cell, own, vectors, best, matrix = cell_of[lo], [], [], [], None
                part = [flat[a:b] for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1])]
                if kind_of[lo] == 0:
                    own += ids[lo:hi].tolist()
                    vectors += [p.copy() for p in part]
                    best += [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(part)
                elif own:
                    for at in range(0, len(part), BLOCK):
                        block = part[at : at + BLOCK]
                        width = max(map(len, block))
                        if matrix is None or matrix.shape[1] < width:
                            width = max(width, *map(len, vectors), 0 if matrix is None else matrix.shape[1])
                            matrix = as_matrix(vectors, width)
                        found = best_of_block(matrix, np.array(own), as_matrix(block, matrix.shape[1]), ids[lo + at : lo + at + BLOCK], k)
                        best = [merge(a, b, k) for a, b in zip(best, found)]
        if best:
            yield result()

    found = cells.mapInArrow(run, "query_id long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
