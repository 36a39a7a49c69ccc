"""Alignment of two tokenizers over the same texts, and how often their tokens end together.

The documents of an Arrow batch are laid end to end on one axis of bytes. The ends of all A tokens, and of all
B tokens, are counted per byte offset once; the batch is cut where both have one. Prefix sums over the tokens
give each its group and its place in the written groups, and differences at document ends give a document's
figures, so there is no loop over tokens or groups.

A cut is one link: its A and its B token end together. Links are counted per pair of ids over the corpus: batches
send distinct pairs with their counts. The most frequent pairs, at most ``max_pairs`` of them, are broadcast;
occurrences of rarer ones are joined by pair, and since they are rare no key of that join is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import vocabularies as V
from lodeseek.llm.arrowtools import limit_batches
from lodeseek.session import materialize

MAX_PAIRS = 1_000_000
#: Bytes of text that are aligned at once; a longer text is aligned alone.
CHUNK_BYTES = 4 << 20
COLUMNS = "uid long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, cuts binary"


@dataclass
class Aligned:
    """Documents of one chunk: tokens and groups per document, where groups end, and what ends there."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    cuts: np.ndarray  # byte offsets on the chunk's axis
    last_a: np.ndarray  # of each group, the number of its last A token
    last_b: np.ndarray
    starts: np.ndarray  # byte offset of each document, and of the end
    first_group: np.ndarray


def cut(sizes_a: np.ndarray, sizes_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, n_bytes: np.ndarray) -> Aligned:
    """sizes: bytes of every token of all documents; n_a, n_b, n_bytes: tokens and bytes per document."""
    starts = np.concatenate([[0], np.cumsum(n_bytes)])
    total = int(starts[-1])
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    both = np.bincount(ends_a, minlength=total + 1) * np.bincount(ends_b, minlength=total + 1)
    cuts = np.flatnonzero(both)
    before = np.concatenate([[0], np.cumsum(both[1:] > 0)]) if total else np.zeros(1, np.int64)
    first_group = before[starts]
    return Aligned(n_a, n_b, np.diff(first_group), cuts, np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts), starts, first_group)


def written(ids_a: np.ndarray, ids_b: np.ndarray, digits_a: np.ndarray, digits_b: np.ndarray, found: Aligned) -> tuple[bytes, np.ndarray]:
    """All groups as ``a1,a2|b1;a3|b2,b3``, documents end to end, and where each document's part ends."""
    ends_group_a, ends_group_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    ends_group_a[found.last_a] = True
    ends_group_b[found.last_b] = True
    group_a, group_b = np.cumsum(ends_group_a) - ends_group_a, np.cumsum(ends_group_b) - ends_group_b
    b_before = np.concatenate([[0], found.last_b + 1])
    place_a = np.arange(len(ids_a)) + b_before[group_a]
    place_b = np.arange(len(ids_b)) + found.last_a[group_b] + 1
    rows = np.zeros((len(ids_a) + len(ids_b), max(digits_a.shape[1], digits_b.shape[1]) + 1), dtype=np.uint8)
    rows[place_a, : digits_a.shape[1]] = digits_a[ids_a]
    rows[place_b, : digits_b.shape[1]] = digits_b[ids_b]
    rows[place_a, -1] = np.where(ends_group_a, ord("|"), ord(","))
    rows[place_b, -1] = np.where(ends_group_b, ord(";"), ord(","))
    tokens = np.cumsum(found.n_a + found.n_b)
    rows[tokens[found.n_b > 0] - 1, -1] = 0  # nothing follows a document's last token
    sizes = np.concatenate([[0], np.cumsum((rows != 0).sum(axis=1))])
    flat = rows.ravel()
    return flat[flat != 0].tobytes(), sizes[tokens]


@dataclass(frozen=True)
class Vocabularies:
    """Files of A (byte-level BPE, also as ranks) and B (pieces); None: the public ones."""

    a: str | None = None
    a_ranks: str | None = None
    b: str | None = None

    def tables(self) -> tuple[tuple[bytes, ...], tuple[bytes, ...]]:
        return V.byte_bpe_bytes(self.a or V.path_of(V.BYTE_BPE)), V.piece_bytes(self.b or V.path_of(V.PIECES))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [V.byte_bpe_ids(" " + t, (), self.a, self.a_ranks) for t in texts]
        return a, V.pieces(self.b or V.path_of(V.PIECES)).encode(texts, num_threads=1)


def align_texts(texts: list[str | None], vocabularies: Vocabularies, with_cuts: bool = False) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, groups_sha256, links, cuts) for each text. Texts without tokens have zeros and an empty digest."""
    table_a, table_b = vocabularies.tables()
    sizes_a, sizes_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (table_a, table_b))
    shown = [i for i, t in enumerate(texts) if t]
    all_a, all_b = vocabularies.encode([texts[i] for i in shown])
    n_a, n_b, n_bytes = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
    kept_a, kept_b = [], []
    for i, a, b in zip(shown, all_a, all_b):
        spelled = b" " + texts[i].encode()
        if b"".join(map(table_a.__getitem__, a)) == spelled and b"".join(map(table_b.__getitem__, b)) == spelled:
            n_a[i], n_b[i], n_bytes[i] = len(a), len(b), len(spelled)
            kept_a.append(np.array(a, dtype=np.int64))
            kept_b.append(np.array(b, dtype=np.int64))
    none = [np.zeros(0, dtype=np.int64)]
    ids_a, ids_b = np.concatenate(kept_a or none), np.concatenate(kept_b or none)
    found = cut(sizes_a[ids_a], sizes_b[ids_b], n_a, n_b, n_bytes)
    text, ends = written(ids_a, ids_b, V.decimal_rows(len(table_a)), V.decimal_rows(len(table_b)), found)
    links = (ids_a[found.last_a] * len(table_b) + ids_b[found.last_b]).astype("<i8")
    at = 0
    for i in range(len(texts)):
        g, end = slice(found.first_group[i], found.first_group[i + 1]), int(ends[i])
        digest = hashlib.sha256(text[at:end]).hexdigest() if n_a[i] else ""
        offsets = (found.cuts[g] - found.starts[i]).astype("<i8").tobytes() if with_cuts else None
        yield int(n_a[i]), int(n_b[i]), int(found.n_groups[i]), digest, links[g].tobytes(), offsets
        at = end


def align(docs: DataFrame, vocabularies: Vocabularies = Vocabularies(), with_cuts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, n_a, n_b, n_groups, n_links, groups_sha256, links, cuts) for each row of docs.

    links: a pair's key, A id times B's vocabulary size plus B id, as 64-bit little-endian numbers in order; cuts, if
    wanted: byte offsets in space+text where groups end, likewise. Null and empty texts, and texts that the vocabularies
    do not spell back, have zeros. Repeated rows return a row each, an empty table none, a null id stays null. Very long
    texts are aligned whole, in memory that grows with the text alone. Other columns of docs, whatever their names, are not read."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= CHUNK_BYTES):
                    size += len(texts[hi] or "")
                    hi += 1
                found = list(zip(*align_texts(texts[lo:hi], vocabularies, with_cuts)))
                columns = [uids[lo:hi], ids[lo:hi], found[0], found[1], found[2], found[2], found[3], found[4], found[5]]
                types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
                names = [c.split()[0] for c in COLUMNS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
                lo = hi

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, COLUMNS)


def link_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(key, n, best) of each pair of ids that is linked anywhere: its links, and whether no pair of the same B id has more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i8")
            keys, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

    counted = aligned.select("links").mapInArrow(partial, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = materialize(counted.withColumn("b", F.pmod("key", F.lit(n_b))), "alignment")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def align_and_count(
    docs: DataFrame, vocabularies: Vocabularies = Vocabularies(), max_pairs: int = MAX_PAIRS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """align()'s counts and digest with n_best and count_sum: links whose pair is its B id's most frequent (ties included), and
    the sum over links of their pairs' counts in the corpus. Rows as align() defines them."""
    spark = docs.sparkSession
    aligned = materialize(align(docs, vocabularies, id_col=id_col, text_col=text_col).drop("cuts"), "alignment")
    pairs = materialize(link_counts(aligned, len(vocabularies.tables()[1])), "alignment")
    rare = pairs.count() > max_pairs
    frequent = (pairs.orderBy(F.desc("n"), "key").limit(max_pairs) if rare else pairs).toArrow()
    key, n, best = (frequent.column(c).to_numpy() for c in ("key", "n", "best"))
    order = np.argsort(key)
    known = spark.sparkContext.broadcast((key[order], n[order], best[order]))
    shown = ["uid", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = known.value
        for batch in batches:
            links = batch.column("links").to_pylist()
            ends = np.cumsum([len(x) // 8 for x in links])
            flat = np.frombuffer(b"".join(links), dtype="<i8")
            at = np.minimum(np.searchsorted(key, flat), max(len(key) - 1, 0))
            hit = key[at] == flat if len(key) else np.zeros(len(flat), bool)
            sums = []
            for values in (best, n):
                running = np.concatenate([[0], np.cumsum(np.where(hit, values[at], 0) if len(key) else np.zeros(len(flat)))]).astype(np.int64)
                sums.append(pa.array(np.diff(running[np.concatenate([[0], ends]).astype(np.int64)])))
            missed = np.concatenate([[0], np.cumsum(~hit)])[np.concatenate([[0], ends]).astype(np.int64)]
            rest = pa.ListArray.from_arrays(pa.array(missed.astype(np.int32)), pa.array(flat[~hit]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shown), *sums, rest], names=[*shown, "n_best", "count_sum", "rest"])

    schema = "uid long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>"
    judged = aligned.mapInArrow(judge, schema)
    if not rare:
        return judged.drop("uid", "rest")
    judged = materialize(judged, "alignment")
    occurrences = judged.select("uid", F.explode("rest").alias("key")).groupBy("uid", "key").agg(F.count("*").alias("times"))
    more = occurrences.join(pairs, "key").groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    added = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return judged.join(more, "uid", "left").select(*shown[1:], *added)
