"""Sharding by a k-d tree over document metadata.

A node that holds several shards is cut at the distributed weighted median (more exactly, at the share of
its shards that go left) of the dimension along which it is widest; leaves are shards of near equal bytes.

The tree is built over *units*: rows of equal text are one unit, so a group stays together. A group heavier than
``unit_share`` of a shard is first dealt into sub-units of at most about that size, which lie side by
side in the order of cuts, so such a group fills as few shards as its size needs. A unit's metadata is the
smallest of its rows', and cuts compare (dimension, text hash, sub-unit), a total order.

A median is found by radix descent: each pass adds up weights in equal bins of the interval that still
holds the cut, for all nodes of a level at once, and goes on inside one bin. The driver sees at most
``bins`` numbers per node; units and rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.session import materialize

LOW, HIGH = -(1 << 63), (1 << 63) - 1
ROW_BYTES = 16


@dataclass(frozen=True)
class Settings:
    shards: int = 40
    unit_share: float = 0.1
    tolerance: float = 0.002
    bins: int = 1024
    slot_buckets: int = 128
    rows_per_bucket: int = 200_000


@dataclass
class Node:
    """A leaf holds shards [first, first + count) still to be parted, or one shard; an inner node has a cut."""

    first: int
    count: int
    cut: tuple[int, int, int, int] | None = None  # dimension, and the first (value, hash, sub) that goes right
    left: int = -1
    right: int = -1


@dataclass
class Search:
    """Where a node's cut is looked for: the fixed part of the order so far and an interval of the next key."""

    dimension: int
    wanted: float
    total: int
    fixed: tuple[int, ...] = ()
    lo: int = LOW
    hi: int = HIGH
    cut: tuple[int, int, int, int] | None = None
    before: float = 0.0
    bins: list = field(default_factory=list)


def leaf_of(tree: Sequence[Node], dims: np.ndarray, g: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """Index of the leaf of each unit; dims is [dimensions, units]."""
    at = np.zeros(len(g), dtype=np.int64)
    for i, node in enumerate(tree):  # children come after their parents
        if node.cut is None:
            continue
        here = at == i
        d, value, gcut, scut = node.cut
        x = dims[d]
        left = (x < value) | ((x == value) & ((g < gcut) | ((g == gcut) & (sub < scut))))
        at[here & left] = node.left
        at[here & ~left] = node.right
    return at


def dimension(df: DataFrame, name: str) -> Column:
    """A column as a long whose order is that of the cuts: numbers by their logarithm, text by its hash; null lowest."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        value = F.signum(F.col(name)) * F.log1p(F.abs(F.col(name).cast("double"))) * float(1 << 40)
        value = F.when(F.isnan(value), None).otherwise(value).cast("long")
    else:
        value = F.when(F.col(name).isNotNull(), F.shiftright(F.xxhash64(F.col(name).cast("string")), 1))
    return F.coalesce(value, F.lit(LOW // 2)).cast("long")


def _arrays(batch: pa.RecordBatch, n_dims: int) -> tuple[np.ndarray, ...]:
    col = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    return np.stack([col(f"d{i}") for i in range(n_dims)]), col("g"), col("sub").astype(np.int64), col("w")


def _extents(units: DataFrame, tree: list[Node], n_dims: int) -> dict[int, tuple[list[int], list[int], int]]:
    """For each leaf the least and largest value of each dimension and its weight."""
    fields = ", ".join(f"lo{i} long, hi{i} long" for i in range(n_dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for batch in batches:
            dims, g, sub, w = _arrays(batch, n_dims)
            leaf = leaf_of(tree, dims, g, sub)
            for at in np.unique(leaf).tolist():
                mask = leaf == at
                lo, hi, total = dims[:, mask].min(1), dims[:, mask].max(1), int(w[mask].sum())
                old = found.setdefault(at, [0, *[HIGH, LOW] * n_dims])
                old[0] += total
                for i in range(n_dims):
                    old[1 + 2 * i], old[2 + 2 * i] = min(old[1 + 2 * i], int(lo[i])), max(old[2 + 2 * i], int(hi[i]))
        rows = [(at, *v) for at, v in found.items()]
        names = ["leaf", "w", *(n for i in range(n_dims) for n in (f"lo{i}", f"hi{i}"))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)

    parts = units.mapInArrow(run, f"leaf long, w long, {fields}").groupBy("leaf").agg(
        F.sum("w").alias("w"), *(f(f"{n}{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max)))
    )
    return {r.leaf: ([r[f"lo{i}"] for i in range(n_dims)], [r[f"hi{i}"] for i in range(n_dims)], r.w) for r in parts.collect()}


def _bins(units: DataFrame, tree: list[Node], searches: dict[int, Search], n_dims: int, n_bins: int) -> None:
    """Fills each search's bins with (bin, weight, least key, largest key), in order."""
    open_ones = {at: (s.dimension, s.fixed, s.lo, s.hi) for at, s in searches.items() if s.cut is None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {at: (np.zeros(n_bins, np.int64), np.full(n_bins, HIGH), np.full(n_bins, LOW)) for at in open_ones}
        for batch in batches:
            dims, g, sub, w = _arrays(batch, n_dims)
            leaf = leaf_of(tree, dims, g, sub)
            for at, (d, fixed, lo, hi) in open_ones.items():
                keys = (dims[d], g, sub)
                mask = leaf == at
                for key, value in zip(keys, fixed):
                    mask &= key == value
                key = keys[len(fixed)]
                mask &= (key >= lo) & (key <= hi)
                key, weight = key[mask], w[mask]
                width = (hi - lo) // n_bins + 1
                index = ((key.view(np.uint64) - np.uint64(lo % (1 << 64))) // np.uint64(width)).astype(np.int64)
                sums, least, most = total[at]
                np.add.at(sums, index, weight)
                np.minimum.at(least, index, key)
                np.maximum.at(most, index, key)
        out = [
            (at, b, int(sums[b]), int(least[b]), int(most[b])) for at, (sums, least, most) in total.items() for b in np.flatnonzero(least <= most).tolist()
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=["leaf", "bin", "w", "lo", "hi"])

    rows = (
        units.mapInArrow(run, "leaf long, bin long, w long, lo long, hi long")
        .groupBy("leaf", "bin")
        .agg(F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .collect()
    )
    for at in open_ones:
        searches[at].bins = sorted((r.bin, r.w, r.lo, r.hi) for r in rows if r.leaf == at)


def _narrow(s: Search, tolerance: float) -> None:
    """Goes on inside the bin that holds the cut, or settles the cut at the nearer side of it."""

    def cut_at(key: int) -> tuple[int, int, int, int]:
        parts = [*s.fixed, key, LOW, LOW][:3]
        return (s.dimension, *parts)

    for _, weight, lo, hi in s.bins:
        if s.before + weight < s.wanted:
            s.before += weight
            continue
        single = lo == hi
        if weight > tolerance and not single:
            s.lo, s.hi = lo, hi
        elif weight > tolerance and len(s.fixed) < 2:
            s.fixed, s.lo, s.hi = (*s.fixed, lo), LOW, HIGH
        elif s.wanted - s.before <= s.before + weight - s.wanted:
            s.cut = cut_at(lo)
        else:
            s.cut = cut_at(hi + 1) if hi < HIGH else cut_at(hi)
        return
    s.cut = cut_at(s.bins[-1][3]) if s.bins else (s.dimension, HIGH, HIGH, HIGH)


def build_tree(units: DataFrame, n_dims: int, s: Settings) -> list[Node]:
    """The last of the dimensions should be the text hash, along which any node can be cut."""
    tree = [Node(0, s.shards)]
    overall: tuple[list[int], list[int], int] | None = None
    while any(n.cut is None and n.count > 1 for n in tree):
        extents = _extents(units, tree, n_dims)
        overall = overall or extents.get(0, ([0] * n_dims, [0] * n_dims, 0))
        tolerance = s.tolerance * overall[2] / s.shards
        searches: dict[int, Search] = {}
        for at, node in enumerate(tree):
            if node.cut is None and node.count > 1:
                lo, hi, total = extents.get(at, ([0] * n_dims, [0] * n_dims, 0))
                widths = [(hi[i] - lo[i]) / max(1, overall[1][i] - overall[0][i]) for i in range(n_dims - 1)]
                widest = max(range(n_dims - 1), key=lambda i: widths[i], default=n_dims - 1)
                if n_dims == 1 or widths[widest] <= 0:
                    widest = n_dims - 1
                searches[at] = Search(widest, total * (node.count // 2) / node.count, total, lo=lo[widest], hi=hi[widest])
        while any(x.cut is None for x in searches.values()):
            _bins(units, tree, searches, n_dims, s.bins)
            for x in searches.values():
                if x.cut is None:
                    _narrow(x, tolerance)
        for at, x in searches.items():
            node = tree[at]
            half = node.count // 2
            node.cut, node.left, node.right = x.cut, len(tree), len(tree) + 1
            tree += [Node(node.first, half), Node(node.first + half, node.count - half)]
    return tree


def shard(
    docs: DataFrame, settings: Settings = Settings(), metadata: Sequence[str] = ("source", "lang", "n_chars"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row once; slots are gapless from 0 in each shard.

    size is the text's UTF-8 bytes plus 16 for the row; null texts and metadata count as empty and lowest, and rows of
    null text are a group. Repeated rows are rows of a group. Metadata columns that docs lacks are not used. An empty
    table returns no rows. If a single text outweighs a shard its shard is larger."""
    s = settings
    spark = docs.sparkSession
    names = [n for n in metadata if n in docs.columns]
    text = F.col(text_col).cast("binary")
    base = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(id_col).cast("long").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).alias("crc"),
            F.xxhash64(F.coalesce(text, F.lit(b""))).alias("g"),
            *(dimension(docs, n).alias(f"d{i}") for i, n in enumerate(names)),
        ),
        "sharding",
    )
    n_dims = len(names) + 1
    groups = materialize(base.groupBy("g").agg(F.sum("size").alias("w")), "sharding")
    total = groups.agg(F.sum("w")).first()[0] or 0
    most = max(1, int(s.unit_share * total / s.shards))
    # At most shards / unit_share groups are that heavy: a bound that the corpus does not move.
    heavy = groups.where(F.col("w") > most).select("g", F.ceil(F.col("w") / most).cast("int").alias("deal"))
    dealt = base.join(F.broadcast(heavy), "g", "left").withColumn(
        "sub", F.when(F.col("deal").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "uid"), F.col("deal")).cast("int"))
    )
    least = groupwise_least(dealt, n_dims - 1)
    units = materialize(least.withColumn(f"d{n_dims - 1}", F.col("g")), "sharding")
    tree = build_tree(units, n_dims, s)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_of = np.array([n.first for n in tree], dtype=np.int32)
        for batch in batches:
            dims, g, sub, _ = _arrays(batch, n_dims)
            at = shard_of[leaf_of(tree, dims, g, sub)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("sub"), pa.array(at)], names=["g", "sub", "shard"])

    where = materialize(units.mapInArrow(place, "g long, sub int, shard int"), "sharding")
    placed = dealt.select("uid", "id", "size", "crc", "g", "sub").join(where, ["g", "sub"])
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "uid"), F.lit(max(s.slot_buckets, base.count() // (s.shards * s.rows_per_bucket)))))
    placed = materialize(placed.select("uid", "id", "size", "crc", "shard", "bucket"), "sharding")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "uid")
    return (
        placed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(first, ["shard", "bucket"])
        .select("id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"))
    )


def groupwise_least(dealt: DataFrame, n: int) -> DataFrame:
    """(g, sub, w, d0..): units with the least metadata of their whole group, heavy groups included."""
    units = dealt.groupBy("g", "sub").agg(F.sum("size").alias("w"), F.max("deal").alias("deal"), *(F.min(f"d{i}").alias(f"d{i}") for i in range(n)))
    if not n:
        return units.drop("deal")
    # Sub-units of one group share its least metadata; only dealt groups need it (a bounded number of units).
    split = units.where("deal IS NOT NULL").groupBy("g").agg(*(F.min(f"d{i}").alias(f"m{i}") for i in range(n)))
    return units.join(F.broadcast(split), "g", "left").select("g", "sub", "w", *(F.coalesce(f"m{i}", f"d{i}").alias(f"d{i}") for i in range(n)))
