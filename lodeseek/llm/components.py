"""Connected components of an edge table: each task solves what it holds, then alternating large-star and small-star steps.

Edges go to tasks in parts of a bounded size, and a task returns its part's components as stars; where all edges fit one part
that is the answer. Else each step is a join with per-node minima, which are partially aggregated before their shuffle
and written, so that the join with a hot node's edges reads both sides from shuffles of their own: Spark broadcasts minima
that are few, and splits the edges where they are many (adaptive skew join). No step gathers a node's neighbours in one
task, and nothing but counts reaches the driver. Steps are cut in shared storage, so a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.session import drop_materialized, materialize

MAX_ROUNDS = 60
EDGES_PER_TASK = 1_000_000


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of one block as stars on each component's smallest node: (node, smallest), node != smallest."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)) for batch in batches if batch.num_rows]
    if got:
        u, v = local_stars(*(np.concatenate(c) for c in zip(*got)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def contracted(edges: DataFrame, per_task: int) -> tuple[DataFrame, bool]:
    """(stars of each part of the edges, written; whether one part held them all)."""
    parts = edges.count() // per_task + 1
    return materialize(edges.coalesce(parts).mapInArrow(_contract, "u long, v long").distinct(), "edges", True), parts == 1


def is_settled(current: DataFrame) -> bool:
    """Whether the edges are stars: each node hangs on one other, on which nothing but such nodes hang."""
    ends = current.select(F.explode(F.array(F.struct("u", F.lit(1).alias("leaf")), F.struct(F.col("v").alias("u"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
    seen = ends.groupBy("u").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("centre"))
    return seen.where("leaf > 1 OR leaf = 1 AND centre = 0").isEmpty()


def connected_components(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """edges (u long, v long), best a written table, -> (node long, component long), the component being its smallest node.
    Only nodes that have an edge to another node are returned; nulls and loops are ignored."""
    start = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    current, done = contracted(start, per_task)
    for _ in range(MAX_ROUNDS):
        if done or is_settled(current):
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = current.union(current.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges", True)
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()  # of a node at most an edge for each task that had it, so no node is hot here
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        small = materialize(small, "edges", True)
        new, done = contracted(small, per_task)
        for table in (current, low, small):
            drop_materialized(table)
        current = new
    raise RuntimeError("components did not settle")
