"""Pairs of near fingerprints by Golay-code fuzzy keys, without listing the pairs of a dense group.

A node has one or more 64-bit fingerprints. Each is cut into segments of 22, 21 and 21 bits, and each segment decoded to
the Golay codewords near it (one or six of them); a key joins a codeword index of one segment with one of another.
Segments that differ in at most two bits share an index, and of three segments with five differing bits in all at most one
has more than two, so every pair within five bits shares a key. Beyond, a pair needs two segments with a common
codeword: measured on random errors a segment is shared at 1, 1, 1, 0.60, 0.60, 0.19 for 0 to 5 differing bits.

A node is sent once for each codeword of its leading segments, not for each key: the task that gets a codeword's nodes
(a *shard*) forms the buckets of the second codeword in memory. Pairs of a bucket are screened by all fingerprints' differing
bits and by the nodes' sizes. There are two passes.

1. Each task returns a forest of its screened pairs, nearest first, so a row for each node at most. Buckets are compared
   ``lags`` rows deep and a shard of over ``shard_rows`` nodes is dealt to several tasks; nodes of such a bucket or
   shard are marked as not settled.
2. All screened pairs of given nodes with different labels (those classes that the forest's links make) are listed, each by one
   owner among the buckets that hold it. A large shard's nodes are dealt in blocks and each pair of blocks is a task
   of its own; two blocks of one class are never paired, so a class of near copies, however large, costs its
   members' comparison with strangers alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import acos, ceil, comb, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import golay
from lodeseek.llm.arrowtools import map_batches, signed
from lodeseek.session import materialize, shuffle_partitions_for

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


@dataclass(frozen=True)
class Settings:
    words: int = 5
    min_jaccard: float = 0.8
    rounds: int = 4  # fingerprints that make keys
    width: int = 8  # fingerprints in all that the first pass screens by
    wide: int = 32  # and the second
    max_bits: int = 20  # in the round of the key
    sigmas: float = 3.3  # of the screen, beyond the mean at min_jaccard
    bits: int | None = None  # a fixed limit of the screen instead
    lags: int = 256
    shard_rows: int = 32_768
    block_rows: int = 1_024


def exact(bits: int, **more) -> Settings:
    """Links of one fingerprint at so many differing bits or fewer, up to five all of them."""
    return Settings(min_jaccard=0.0, rounds=1, width=1, wide=1, max_bits=bits, bits=bits, **more)


SMALL_SET = 128
#: Rows of a node in a round: the codewords of two segments.
ROWS_PER_ROUND = 11


def fingerprint_columns(rounds: int) -> list[str]:
    return ["fp", *(f"fp{r}" for r in range(1, rounds))]


@lru_cache(maxsize=8)
def bit_limits(min_jaccard: float, width: int, sigmas: float) -> np.ndarray:
    """The most differing bits by the size of the smaller set (up to SMALL_SET, then as for large sets).

    A bit of two sets differs if the sums of their shingles' bits fall on different sides of the half. For small sets
    that is counted exactly, over the larger sets and the overlaps that just reach the limit; it tends to the angle
    between the sets' indicator vectors."""

    def upper(n: int) -> np.ndarray:
        return np.array([comb(n, k) for k in range(n + 1)], dtype=float) / 2.0**n

    def differ(a: int, b: int, common: int) -> float:
        shared = upper(common)

        def over_half(size: int) -> np.ndarray:
            rest = upper(size - common)
            return np.array([rest[max(0, size // 2 + 1 - s) :].sum() for s in range(common + 1)])

        x, y = over_half(a), over_half(b)
        return float((shared * (x * (1 - y) + y * (1 - x))).sum())

    bits = 64 * width
    limit = lambda p: ceil(bits * p + sigmas * sqrt(bits * p * (1 - p)))
    out = np.zeros(SMALL_SET + 1, dtype=np.int64)
    for n in range(1, SMALL_SET):
        p = 0.0
        for m in range(n, int(n / min_jaccard + 1e-9) + 1):
            common = ceil(min_jaccard * (n + m) / (1 + min_jaccard) - 1e-9)
            if common <= n:
                p = max(p, differ(n, m, common))
        out[n] = limit(p)
    out[SMALL_SET] = max(limit(acos(2 * min_jaccard / (1 + min_jaccard)) / pi), out[SMALL_SET - 1] if min_jaccard < 1 else 0)
    return out


def limits_of(s: Settings, width: int) -> np.ndarray:
    return bit_limits(s.min_jaccard, width, s.sigmas) if s.bits is None else np.full(SMALL_SET + 1, s.bits)


def segment(fp: np.ndarray, i: int) -> np.ndarray:
    shift, width = SEGMENTS[i]
    return ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)


def shards_of(fp: np.ndarray, turn: int, prefix_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, row) for the fingerprints (unsigned) of one round: a shard is a round, a pair of segments, a codeword of the first
    and the leading bits of one of the second. Without prefix bits pairs of the same first segment share their shards."""
    slot = np.arange(6)
    found = [golay.keys(segment(fp, i)) for i in range(3)]
    shards, rows = [], []
    for p, (i, j) in enumerate(PAIRS):
        if prefix_bits == 0 and p == 1:
            continue
        codes, counts = found[i]
        use = slot < counts[:, None]
        if prefix_bits == 0:
            shard = codes << 12
        else:
            second, n = found[j]
            lead = np.where(slot < n[:, None], second >> (12 - prefix_bits), second[:, :1] >> (12 - prefix_bits))
            lead.sort(axis=1)
            fresh = np.concatenate([np.ones((len(fp), 1), bool), lead[:, 1:] != lead[:, :-1]], axis=1)
            use = use[:, :, None] & fresh[:, None, :]
            shard = (codes[:, :, None] << 12) | lead[:, None, :]
        shard = ((turn * 3 + p) << 24) | shard
        shards.append(shard[use])
        rows.append(np.nonzero(use)[0])
    return np.concatenate(shards), np.concatenate(rows)


def all_shards(fps: np.ndarray, s: Settings, prefix_bits: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [shards_of(np.ascontiguousarray(fps[:, turn]), turn, prefix_bits) for turn in range(s.rounds)]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(2))


@dataclass
class Rows:
    """Nodes of one task, a row for each shard they are in. task tells shards (or pairs of blocks) apart."""

    task: np.ndarray
    shard: np.ndarray
    node: np.ndarray
    n: np.ndarray
    fps: np.ndarray  # [rows, SimHashes], unsigned
    label: np.ndarray
    side: np.ndarray
    whole: np.ndarray  # False in a pair of blocks, where only rows of different sides meet


def buckets(r: Rows, prefix_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each bucket's run, its length, row numbers in order of buckets, each one's key as of first_common_key)."""
    slot = np.arange(6)
    _, group = np.unique(r.task, return_inverse=True)
    pair = (r.shard >> 24) % 3
    own = r.fps[np.arange(len(r.task)), r.shard // (3 << 24)]
    place, rows, full = [], [], []
    for p, (_, j) in enumerate(PAIRS):
        here = np.flatnonzero((pair == p) | ((pair == 0) if p == 1 and prefix_bits == 0 else False))
        codes, counts = golay.keys(segment(own[here], j))
        use = slot < counts[:, None]
        if prefix_bits:
            use &= (codes >> (12 - prefix_bits)) == (r.shard[here] & 0xFFF)[:, None]
        place.append(((group[here][:, None] << 14) | (p << 12) | codes)[use])
        full.append(((p << 24) | (r.shard[here] & 0xFFF000)[:, None] | codes)[use])
        rows.append(here[np.nonzero(use)[0]])
    place, rows, full = (np.concatenate(x) for x in (place, rows, full))
    order = np.lexsort((r.label[rows], place))
    place, rows, full = place[order], rows[order], full[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(place))), rows, full


def near_rows(r: Rows, rows: np.ndarray, x: np.ndarray, y: np.ndarray, limits: np.ndarray, s: Settings, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(which of the places x, y hold pairs that pass the screen, their differing bits)."""
    a, b = rows[x], rows[y]
    turn = r.shard[a] // (3 << 24)
    ok = np.bitwise_count(r.fps[a, turn] ^ r.fps[b, turn]) <= s.max_bits
    small, large = np.minimum(r.n[a], r.n[b]), np.maximum(r.n[a], r.n[b])
    ok &= (small + 1e-6 >= s.min_jaccard * large) & (r.node[a] != r.node[b])
    ok = np.flatnonzero(ok)
    bits = np.bitwise_count(r.fps[a[ok]] ^ r.fps[b[ok]]).sum(axis=1, dtype=np.int64)
    near = bits <= share * limits[np.minimum(small[ok], SMALL_SET)]
    return ok[near], bits[near]


def forest(r: Rows, prefix_bits: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v) of a forest that connects what the rows' screened pairs connect, and the nodes of buckets not compared as a whole."""
    first, length, rows, _ = buckets(r, prefix_bits)
    limits = limits_of(s, r.fps.shape[1])
    nodes, at = np.unique(r.node, return_inverse=True)
    label = np.arange(len(nodes))
    size = np.repeat(length, length)
    place = np.arange(len(rows)) - np.repeat(first, length)
    us, vs = [], []

    def join(found: list) -> None:
        nonlocal label
        x, y, d = (np.concatenate([f[k] for f in found]) for k in range(3))
        fresh = label[x] != label[y]
        x, y, d = x[fresh], y[fresh], d[fresh]
        keep = forest_edges(label[x], label[y], d)
        us.append(nodes[x[keep]])
        vs.append(nodes[y[keep]])
        to = np.arange(len(nodes))
        a, b = label[x[keep]], label[y[keep]]
        while True:
            low = np.minimum(to[a], to[b])
            new = to.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if np.array_equal(new, to):
                break
            to = new
        label = to[label]

    for share in (0.5, 0.75, 1.0):  # nearer pairs first
        live = np.flatnonzero(size > 1)
        found, waiting = [], 0
        for lag in range(1, s.lags + 1):
            live = live[place[live] + lag < size[live]]
            if not len(live):
                break
            for i in range(0, len(live), 1 << 17):
                x = live[i : i + (1 << 17)]
                x = x[label[at[rows[x]]] != label[at[rows[x + lag]]]]
                ok, d = near_rows(r, rows, x, x + lag, limits, s, share)
                if len(ok):
                    found.append((at[rows[x[ok]]], at[rows[x[ok] + lag]], d))
                    waiting += len(ok)
            if waiting > 50_000:
                join(found)
                found, waiting = [], 0
        if found:
            join(found)
    deep = np.unique(r.node[rows[size > s.lags + 1]])
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return cat(us), cat(vs), deep


def pairs_across(r: Rows, prefix_bits: int, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All screened pairs (u, v) of nodes with different labels, each from its first common key alone."""
    first, length, rows, full = buckets(r, prefix_bits)
    limits = limits_of(s, r.fps.shape[1])
    mixed = r.label[rows[first]] != r.label[rows[first + length - 1]] if len(first) else np.zeros(0, bool)
    size = np.repeat(np.where(mixed, length, 0), length)
    place = np.arange(len(rows)) - np.repeat(first, length)
    lag, live = 1, np.flatnonzero(size > 1)
    while len(live):
        live = live[place[live] + lag < size[live]]
        for i in range(0, len(live), 1 << 17):
            x = live[i : i + (1 << 17)]
            a, b = rows[x], rows[x + lag]
            x = x[(r.label[a] != r.label[b]) & (r.whole[a] | (r.side[a] != r.side[b]))]
            ok, _ = near_rows(r, rows, x, x + lag, limits, s)
            x = x[ok]
            if len(x):
                a, b = rows[x], rows[x + lag]
                owner = np.full(len(x), -1, dtype=np.int64)
                for turn in reversed(range(s.rounds)):
                    fa, fb = np.ascontiguousarray(r.fps[a, turn]), np.ascontiguousarray(r.fps[b, turn])
                    key = first_common_key(fa.view(np.int64), fb.view(np.int64))
                    meet = (key >= 0) & (np.bitwise_count(fa ^ fb) <= s.max_bits)
                    owner[meet] = ((turn << 26) | key)[meet]
                mine = owner == (((r.shard[a] // (3 << 24)) << 26) | full[x])
                yield r.node[a[mine]], r.node[b[mine]]
        lag += 1


def forest_edges(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows are in a minimum spanning forest, nearest first. Rows of one bucket only meet each other."""
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = up
        return i

    keep = []
    order = np.argsort(d, kind="stable")
    for e, i, j in zip(order.tolist(), x[order].tolist(), y[order].tolist()):
        i, j = find(i), find(j)
        if i != j:
            parent[i] = j
            keep.append(e)
    return np.array(keep, dtype=np.int64)


def first_common_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key that each pair of fingerprints shares; -1 where they share none."""
    common = []
    for shift, width in SEGMENTS:
        (ca, na), (cb, nb) = (golay.keys(((x.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)) for x in (a, b))
        slot = np.arange(6)
        same = (ca[:, :, None] == cb[:, None, :]) & (slot < na[:, None])[:, :, None] & (slot < nb[:, None])[:, None, :]
        common.append(np.where(same, ca[:, :, None].astype(np.int64), 1 << 12).min(axis=(1, 2)))
    out = np.full(len(a), -1, dtype=np.int64)
    for p, (i, j) in reversed(list(enumerate(PAIRS))):
        both = (common[i] < 1 << 12) & (common[j] < 1 << 12)
        out[both] = ((p << 24) | (common[i] << 12) | common[j])[both]
    return out


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _fps(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.stack(_numbers(batch, fingerprint_columns(width)), axis=1).view(np.uint64)


def large_shards(nodes: DataFrame, s: Settings, prefix_bits: int) -> dict[int, int]:
    """Shards of over shard_rows nodes, and over how many tasks each is dealt. There are 8,192 shards a round (times 2**prefix_bits,
    which makes the usual shard small), so what reaches the driver is a share of a fixed number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, n = np.unique(all_shards(_fps(batch, s.rounds), s, prefix_bits)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"shard": shard.astype(np.int64), "n": n.astype(np.int64)})

    found = nodes.select(*fingerprint_columns(s.rounds)).mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    return {r.shard: -(-r.n // s.shard_rows) for r in found.where(F.col("n") > s.shard_rows).collect()}


def first_pass(nodes: DataFrame, s: Settings, prefix_bits: int, parts: int) -> DataFrame:
    """(u long, v long): each task's forest, and (node, node) for the nodes of buckets and shards not compared as a whole."""
    large = large_shards(nodes, s, prefix_bits)
    big = np.array(sorted(large), dtype=np.int64)
    tasks = np.array([large[x] for x in sorted(large)], dtype=np.int64)
    names = fingerprint_columns(s.width)
    fields = ", ".join(f"{n} long" for n in names)

    def keyed(batch: pa.RecordBatch) -> dict:
        fps = _fps(batch, s.width)
        node, n = _numbers(batch, ["node", "n"])
        shard, row = all_shards(fps, s, prefix_bits)
        deal = np.zeros(len(shard), dtype=np.int64)
        if large:
            at = np.minimum(np.searchsorted(big, shard), len(big) - 1)
            here = np.flatnonzero(big[at] == shard)
            deal[here] = (node[row[here]] * 2654435761 >> 7) % tasks[at[here]]
        return {"shard": shard, "deal": deal, "node": node[row], "n": n[row]} | {c: signed(fps[row, i]) for i, c in enumerate(names)}

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if sum(b.num_rows for b in got) == 0:
            return
        shard, deal, node, n = (np.concatenate(c) for c in zip(*(_numbers(b, ["shard", "deal", "node", "n"]) for b in got)))
        fps = np.concatenate([_fps(b, s.width) for b in got])
        none = np.zeros(len(node), dtype=np.int64)
        r = Rows((shard << 24) | deal, shard, node, n, fps, none, none, none == 0)
        u, v, deep = forest(r, prefix_bits, s)
        if large:
            deep = np.union1d(deep, node[np.isin(shard, big)])
        yield pa.RecordBatch.from_pydict({"u": np.concatenate([np.minimum(u, v), deep]), "v": np.concatenate([np.maximum(u, v), deep])})

    rows = map_batches(nodes.select("node", "n", *names), keyed, f"shard long, deal long, node long, n int, {fields}")
    return rows.repartition(parts, "shard", "deal").mapInArrow(forests, "u long, v long").distinct()


def second_pass(nodes: DataFrame, s: Settings, prefix_bits: int, parts: int) -> DataFrame:
    """(u long, v long): nodes (node, n, label, fps) -> every screened pair of different labels, once."""
    names = fingerprint_columns(s.wide)
    fields = ", ".join(f"{n} long" for n in names)
    # Few labels are that large; written, their size is known, so Spark broadcasts them and no label's nodes meet in one task.
    sizes = materialize(nodes.groupBy("label").count().where(F.col("count") > s.block_rows), "nearsets", True)
    classed = nodes.join(sizes.select("label", F.col("label").alias("cls")), "label", "left").withColumn("cls", F.coalesce("cls", F.lit(-1).cast("long")))

    def keyed(batch: pa.RecordBatch) -> dict:
        fps = _fps(batch, s.wide)
        shard, row = all_shards(fps, s, prefix_bits)
        return {"shard": shard} | {c: batch.column(c).take(pa.array(row)) for c in ("node", "n", "label", "cls", *names)}

    rows = map_batches(classed.select("node", "n", "label", "cls", *names), keyed, f"shard long, node long, n int, label long, cls long, {fields}")
    counts = materialize(rows.groupBy("shard", "cls").agg(F.count("*").alias("n")), "nearsets", True)
    heavy = materialize(
        counts.join(counts.groupBy("shard").agg(F.sum("n").alias("all")).where(F.col("all") > s.block_rows).select("shard"), "shard", "left_semi")
        .withColumn("blocks", F.ceil(F.col("n") / s.block_rows).cast("int")).drop("n"),
        "nearsets",
    )
    plain = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    if not heavy.isEmpty():
        block = heavy.select("shard", "cls", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
        one, two = (block.select("shard", *(F.col(c).alias(f"{c}{x}") for c in ("cls", "k"))) for x in "ab")
        meet = one.join(two, "shard").where("(clsa < clsb OR clsa = clsb AND ka <= kb) AND NOT (clsa = clsb AND clsa >= 0)")
        meet = meet.withColumns({"i": F.xxhash64("clsa", "ka"), "j": F.xxhash64("clsb", "kb")})
        ways = meet.select("shard", F.col("clsa").alias("cls"), F.col("ka").alias("k"), "i", "j", F.lit(0).alias("side")).union(
            meet.where("i <> j").select("shard", "clsb", "kb", "i", "j", F.lit(1))
        )
        dealt = rows.join(heavy, ["shard", "cls"]).withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        plain = plain.join(heavy.select("shard").distinct(), "shard", "left_anti").unionByName(dealt.join(ways, ["shard", "cls", "k"]).drop("blocks", "k"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        columns = ["shard", "node", "n", "label", "i", "j", "side"]
        shard, node, n, label, i, j, side = (np.concatenate(c) for c in zip(*(_numbers(b, columns) for b in got)))
        _, task = np.unique(np.stack([shard, i, j]), axis=1, return_inverse=True)
        r = Rows(task.reshape(-1), shard, node, n, np.concatenate([_fps(b, s.wide) for b in got]), label, side, i == j)
        for u, v in pairs_across(r, prefix_bits, s):
            yield pa.RecordBatch.from_pydict({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    plain = plain.select("shard", "node", "n", "label", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "side", *names)
    return plain.repartition(parts, "shard", "i", "j").mapInArrow(pairs, "u long, v long")


def prefix_bits_for(total: int, s: Settings) -> int:
    """Leading bits of the second codeword that part shards, so that the usual shard is small whatever the number of nodes."""
    return min(12, max(0, int(4 * 5.3 * total / 4096 / s.shard_rows).bit_length()))


def partitions_for(nodes: DataFrame, total: int, s: Settings, width: int) -> int:
    return shuffle_partitions_for(nodes.sparkSession, total * s.rounds * ROWS_PER_ROUND * (8 * width + 64))
