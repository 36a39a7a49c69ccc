"""Packing token sequences into windows by non-negative least squares.

A document's ids are cut into full windows and one rest. The rests' lengths form a histogram of at most
``window`` bins, whatever the corpus. Shallow combinations of lengths that fill a window exactly (pairs,
and some triples and quadruples) are its columns; non-negative least squares finds how often to use each,
rounding keeps within the histogram and what it leaves is packed greedily: rests in order of length, end
to end, cut where a window is full, so that only the last window of all can need padding.

Only the histogram (bounded by the window and a number of buckets) reaches the driver. A rest's place
follows from its rank among the rests of its length: ranks come from (length, bucket) counts and a row
number inside each bucket, so that a length that a third of all documents share is spread over buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm import vocabularies
from lodeseek.llm.arrowtools import limit_batches
from lodeseek.session import materialize

WINDOW = 1024
END_ID = 0
#: The added token of byte_bpe_50k.json, which tokenizers finds in texts too.
SPECIAL_TOKENS = {"<|endoftext|>": 50256}
MIN_BUCKETS = 128
ROWS_PER_BUCKET = 200_000


def default_vocabulary() -> str:
    """The byte-level BPE of tokenizers' byte_bpe_50k.json, in the form of ranks that tiktoken reads: the same ids, faster."""
    return vocabularies.path_of(vocabularies.BYTE_BPE_RANKS)


def ids_of(text: str | None, vocabulary: str, end_id: int | None = END_ID) -> np.ndarray:
    """Ids of a text. Where tiktoken gives up (a million blanks in a row) the tokenizers library reads the .json file beside the ranks."""
    ids = vocabularies.byte_bpe_ids(text, tuple(SPECIAL_TOKENS.items()), vocabulary.removesuffix(".tiktoken") + ".json", vocabulary) if text else []
    return np.array(ids if end_id is None else [*ids, end_id], dtype="<u4")


def tokenized_pieces(docs: DataFrame, window: int, vocabulary: str | None, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, start, length, crc, doc_tokens, ids): the full windows and the rest of each row; ids only of rests."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or default_vocabulary()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for uid, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = ids_of(text, path, end_id)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window].tobytes()
                    rest = piece if len(piece) < 4 * window else None
                    for column, value in zip(out, (uid, doc, start, len(piece) // 4, zlib.crc32(piece), len(ids), rest)):
                        column.append(value)
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["uid", "id", "start", "length", "crc", "doc_tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, "uid long, id long, start long, length long, crc long, doc_tokens long, ids binary")


def combinations(window: int) -> list[tuple[int, ...]]:
    """Length combinations that fill the window: all pairs, and triples and quadruples of like or near lengths."""
    found = {(a, window - a) for a in range(1, window // 2 + 1)}
    gaps = [0] + [1 << k for k in range(window.bit_length())]
    for a in range(1, window // 3 + 1):
        found |= {tuple(sorted((a, a + g, window - 2 * a - g))) for g in gaps if window - 2 * a - g >= 1}
        if window - 3 * a >= 1:
            found.add(tuple(sorted((a, a, a, window - 3 * a))))
    return sorted(found)


def solve_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 30) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2, by cyclic coordinate descent with clipping at zero
    (each step is the exact minimum along its coordinate, so the loss never rises; the problem is convex)."""
    columns = [np.unique(c, return_counts=True) for c in combos]
    columns = [(l.tolist(), m.tolist(), float((m * m).sum())) for l, m in columns]
    x = np.zeros(len(combos))
    rest = histogram.astype(float).tolist()
    for _ in range(sweeps):
        moved = 0.0
        for j, (lengths, times, norm) in enumerate(columns):
            step = sum(m * rest[l] for l, m in zip(lengths, times)) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved += abs(step)
                for l, m in zip(lengths, times):
                    rest[l] -= m * step
        if moved < 1:
            break
    return x


def round_counts(x: np.ndarray, combos: list[tuple[int, ...]], histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole counts, what is left of the histogram): rounded down within the histogram, then each combination as often as still fits."""
    left = histogram.astype(np.int64).tolist()
    out = np.zeros(len(combos), dtype=np.int64)
    for whole in (True, False):
        for j in np.argsort(-x, kind="stable"):
            lengths, times = np.unique(combos[j], return_counts=True)
            n = min(left[l] // m for l, m in zip(lengths.tolist(), times.tolist()))
            n = min(n, int(x[j])) if whole else n
            if n > 0:
                out[j] += n
                for l, m in zip(lengths.tolist(), times.tolist()):
                    left[l] -= n * m
    return out, np.array(left, dtype=np.int64)


@dataclass
class Layout:
    """Intervals of ranks of each length: (length, first rank) sorted, with the sequence and offset of the first rank.
    step_tokens is 0 where each rank has a sequence of its own, or the length where rests follow end to end."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    step_tokens: np.ndarray
    sequences: int


RANK_BITS = 44


def plan_layout(histogram: np.ndarray, window: int) -> Layout:
    """histogram[l] for l in 0..window (full windows at the end) -> where every rank of every length goes."""
    rests = histogram.copy()
    rests[window] = 0
    combos = combinations(window)
    counts, left = round_counts(solve_counts(rests, combos), combos, rests)
    rows: list[tuple[int, int, int, int, int]] = [(window, 0, 0, 0, 0)]
    sequence = int(histogram[window])
    used = np.zeros(window + 1, dtype=np.int64)
    for j in np.flatnonzero(counts):
        offset = 0
        for length in combos[j]:
            rows.append((length, int(used[length]), sequence, offset, 0))
            used[length] += counts[j]
            offset += length
        sequence += int(counts[j])
    tokens = 0  # of the rests that follow end to end
    for length in range(1, window):
        rows.append((length, int(used[length]), sequence + tokens // window, tokens % window, length))
        tokens += int(left[length]) * length
    rows.sort()
    length, rank, seq, offset, step = (np.array(c, dtype=np.int64) for c in zip(*rows))
    return Layout((length << RANK_BITS) | rank, seq, offset, step, sequence + -(-tokens // window))


def pack(
    docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece of every row, each id in exactly one.

    Null and empty texts have the end id alone. A repeated row is packed each time; a null id is kept. Long texts
    are cut at windows, runs of millions of blanks among them. Rests of one length that tie are ordered by id, row and place, so the
    windows do not hang on partitioning; other columns, whatever their names, are not read. Without an end id an empty text has no piece. An empty table returns no rows."""
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, window, vocabulary, end_id, id_col, text_col), "packing")
    light = pieces.drop("ids")
    buckets = max(MIN_BUCKETS, light.count() // ROWS_PER_BUCKET)
    light = light.withColumn("bucket", F.pmod(F.xxhash64("uid", "start"), F.lit(buckets)))
    sizes = materialize(light.groupBy("length", "bucket").agg(F.count("*").alias("n")), "packing")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    layout = spark.sparkContext.broadcast(plan_layout(histogram, window))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "uid", "start")
    ranked = light.withColumn("rank", F.row_number().over(inside) - 1).join(first, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = layout.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            key = (length << RANK_BITS) | rank
            at = np.searchsorted(p.key, key, "right") - 1
            ahead = key - p.key[at]
            step = p.step_tokens[at]
            tokens = p.offset[at] + step * ahead
            sequence = p.sequence[at] + np.where(step > 0, tokens // window, ahead)
            offset = np.where(step > 0, tokens % window, p.offset[at])
            names = ["uid", "id", "start", "length", "crc", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence", "offset"]
            )

    schema = "uid long, id long, start long, length long, crc long, doc_tokens long, sequence long, offset long"
    placed = materialize(ranked.select("uid", "id", "start", "length", "crc", "doc_tokens", "rank").mapInArrow(place, schema), "packing")
    over = F.col("offset") + F.col("length") > window
    # Few rests are cut: they are written first, so that Spark knows their size before it decides whether ids must move.
    cut = materialize(placed.where(over), "packing").join(pieces.select("uid", "start", "ids"), ["uid", "start"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for r in batch.to_pylist():
                head = window - r["offset"]
                for a, b, seq, off in ((0, head, r["sequence"], r["offset"]), (head, r["length"], r["sequence"] + 1, 0)):
                    row = (r["id"], r["start"] + a, b - a, zlib.crc32(r["ids"][4 * a : 4 * b]), r["doc_tokens"], seq, off)
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    halves = cut.mapInArrow(split, ", ".join(f"{n} long" for n in names))
    whole = placed.where(~over).select(
        "id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), "offset"
    )
    return whole.unionByName(halves)
