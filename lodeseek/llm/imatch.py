"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose document frequency, counted over all documents, lies in a band: neither
so common that every text has them nor so rare that one edit's novelties count. Both ends of the band are shares
of the number of documents (the lower one at least two documents), so the lexicon holds at most the mean number
of a text's distinct terms divided by the lower share, however many documents and distinct words there are.
Terms (words, ASCII letters and digits in lower case) are known by 32-bit hashes.

A fingerprint hashes, for several random subsets of the lexicon, the sorted distinct terms of the text that
the subset holds. An edit changes only the subsets that hold an edited term. Subsets come in scales, each a
quarter as dense as the one before, since a long text has terms in every dense subset and a short one few
in any sparse one; likeness is the share of equal subsets at the sparsest scale that still tells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.arrowtools import LOWER_ALNUM, limit_batches, map_batches, texts_of
from lodeseek.session import materialize, shuffle_partitions_for


@dataclass(frozen=True)
class Settings:
    min_df: int = 2
    min_df_share: float = 1e-5
    max_df_share: float = 0.2
    max_terms: int = 1 << 24
    scales: int = 7
    subsets: int = 20
    quarter: int = 2  # log2 of how much sparser each scale is
    seed: int = 3


def hashes_of(text: bytes, s: Settings) -> np.ndarray:
    words = set(text.translate(LOWER_ALNUM).split())
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, words, repeat(s.seed)), dtype=np.uint32, count=len(words)))


def document_frequencies(docs: DataFrame, s: Settings, text_col: str = "text") -> DataFrame:
    """(term long, df long) over all documents; each batch of texts and then each task is added up before the shuffle."""
    limit_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes_of(text or b"", s) for text in batch.column(0).cast(pa.large_binary()).to_pylist()]
            term, df = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])

    found = docs.select(F.col(text_col).alias("_t")).mapInArrow(count, "term long, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Lexicon:
    """The kept terms in order, and a bitmap of their leading bits that most other terms fail."""

    terms: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(terms: np.ndarray) -> Lexicon:
        bits = np.zeros(1 << 20, dtype=bool)
        bits[terms >> np.uint32(12)] = True
        return Lexicon(np.sort(terms), bits)

    def kept(self, h: np.ndarray) -> np.ndarray:
        h = h[self.bits[h >> np.uint32(12)]]
        at = np.searchsorted(self.terms, h)
        return h[self.terms[np.minimum(at, len(self.terms) - 1)] == h] if len(self.terms) else h[:0]


def build_lexicon(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> Lexicon:
    """The terms in the band, four bytes each: their number is bounded (see above) and checked against max_terms."""
    s = settings
    n = docs.count()
    least, most = max(s.min_df, int(s.min_df_share * n)), max(s.min_df, int(s.max_df_share * n))
    kept = materialize(document_frequencies(docs, s, text_col).where(F.col("df").between(least, most)).select("term"), "imatch", True)
    if (size := kept.count()) > s.max_terms:
        raise ValueError(f"{size} terms in the band, over max_terms; raise min_df_share")
    packed_terms = map_batches(kept, lambda batch: {"terms": [batch.column(0).to_numpy(zero_copy_only=False).astype("<u4").tobytes()]}, "terms binary")
    return Lexicon.of(np.frombuffer(b"".join(bytes(r.terms) for r in packed_terms.collect()), dtype="<u4"))


#: Terms mixed with all subsets' keys at a time.
TERM_BLOCK = 4096


def fingerprint(text: bytes, lexicon: Lexicon, s: Settings) -> np.ndarray:
    """[scales, subsets] of uint16: a hash of the subset's distinct terms in the text, 0 where it has none.

    Terms are sorted and distinct; a subset's hash adds up their mixed values, block by block. A subset of a sparser
    scale is part of the one before, so what each scale adds up is a quarter of what the scale before did."""
    h = lexicon.kept(hashes_of(text, s))
    total = np.zeros((s.scales, s.subsets), dtype=np.uint64)
    odd = subset_keys(s)[0][: s.subsets, None]
    for i in range(0, len(h), TERM_BLOCK):
        mix = h[i : i + TERM_BLOCK].astype(np.uint64) * odd
        mix ^= mix >> np.uint64(31)
        mix *= np.uint64(0x9E3779B97F4A7C15)
        total[0] += mix.sum(axis=1)
        values, subset = mix.reshape(-1), np.repeat(np.arange(s.subsets), mix.shape[1])
        for scale in range(1, s.scales):
            inside = np.flatnonzero((values >> np.uint64(40)) & np.uint64((1 << (s.quarter * scale)) - 1) == 0)
            if not len(inside):
                break
            values, subset = values[inside], subset[inside]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
            end = np.searchsorted(subset, np.arange(s.subsets), "right")
            total[scale] += sums[end] - np.concatenate([sums[:1], sums[end[:-1]]])
    total ^= total >> np.uint64(32)
    code = (total >> np.uint64(7)).astype(np.uint16) | np.uint16(1)
    return np.where(total == 0, 0, code).astype(np.uint16)


@lru_cache(maxsize=4)
def subset_keys(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each subset, scale by scale: an odd multiplier (alike at all scales) and the mask of bits that must be clear."""
    rng = np.random.RandomState(s.seed)
    odd = (rng.randint(1, 1 << 62, s.subsets).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    return np.tile(odd, s.scales), np.repeat([(1 << (s.quarter * scale)) - 1 for scale in range(s.scales)], s.subsets).astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the share of equal subsets, of those with a term in either text, at the sparsest scale where at least a
    third of the subsets have one; texts with no term of the lexicon at any scale are alike only if both have none."""
    best = None
    for scale in range(len(a)):
        filled = (a[scale] != 0) | (b[scale] != 0)
        if best is None or filled.sum() * 3 >= a.shape[1]:
            best = (filled, a[scale] == b[scale])
    filled, equal = best
    if not filled.any():
        return 1.0 if not a.any() and not b.any() else 0.0
    return float((equal & filled).sum() / filled.sum())


def packed(fp: np.ndarray) -> bytes:
    return fp.astype(">u2").tobytes()


def written(fp: np.ndarray) -> str:
    return packed(fp).hex()


def fingerprints(docs: DataFrame, lexicon: Lexicon, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row; null and empty texts have the fingerprint of no terms, all zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "fingerprint": [written(fingerprint(t, shared.value, settings)) for t in texts_of(batch, "_t")]}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t")), run, "id long, fingerprint string")


#: Fingerprints stay binary until the end: half the bytes to keep between the two jobs.
RESULT = "id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first characters of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compared(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray, lexicon: Lexicon, s: Settings) -> tuple:
    changed = edited(text, following).encode()
    fp = fingerprint(changed, lexicon, s)
    return doc_id, len(text), hashlib.sha256(changed).digest(), packed(own), packed(fp), likeness(own, fp), likeness(own, other)


def compare_with_next(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_bytes: int = 24 << 20) -> DataFrame:
    """RESULT (binary columns as lower-case hex) for each row: its fingerprint, that of its edited text and the likeness to that and to the next document.

    Null texts are empty; a text without a term of the lexicon has the fingerprint of all zeros. Repeated rows return a row each.
    An empty table returns no rows. Terms of very long texts are mixed in blocks. Other columns of docs are not read.

    Next is by descending id (nulls last, equal ids by a hash of their texts); after the last comes the first. One range
    exchange sorts the texts, and a pass over each sorted partition compares neighbours. A partition's last row meets the
    first row of the next partition that has any in a join with one row per partition."""
    s = settings
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(build_lexicon(docs, s, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(shuffle_partitions_for(spark, size, target_bytes), *order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("part", F.spark_partition_id())
    limit_batches(spark)
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    extra = [("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())]

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * (len(names) + 3)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [*types, *(t for _, t in extra)])], names=[*names, *(n for n, _ in extra)]
        )

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, before, part = shared.value, None, None
        for batch in batches:
            out = []
            for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "part"))):
                fp = fingerprint(text.encode(), lexicon, s)
                if before is None:
                    out.append((None,) * 7 + (part, text, None))
                else:
                    out.append(compared(*before, text, fp, lexicon, s) + (None, None, None))
                before = (doc_id, text, fp)
            yield as_batch(out)
        if before is not None:
            yield as_batch([(before[0],) + (None,) * 6 + (part, None, before[1])])

    inner = materialize(ordered.mapInArrow(neighbours, RESULT + ", part int, head string, tail string"), "imatch")
    heads = inner.where("head IS NOT NULL").select("part", "head")
    by_part = Window.orderBy("part")  # one row per partition that has rows
    after = inner.where("head IS NOT NULL").select("part").withColumn("after", F.lead("part").over(by_part))
    after = after.select("part", F.coalesce("after", F.min("part").over(Window.partitionBy())).alias("after"))
    border = (
        inner.where("tail IS NOT NULL").select("id", "tail", "part").join(after, "part").join(heads.withColumnRenamed("part", "after"), "after").select("id", "tail", "head")
    )

    def across(batch: pa.RecordBatch) -> dict:
        out = [
            compared(i, t, fingerprint(t.encode(), shared.value, s), h, fingerprint(h.encode(), shared.value, s), shared.value, s)
            for i, t, h in zip(*(batch.column(c).to_pylist() for c in ("id", "tail", "head")))
        ]
        return dict(zip(names, zip(*out)))

    found = inner.where("fingerprint IS NOT NULL").select(*names).unionByName(map_batches(border, across, RESULT))
    return found.select(*(F.lower(F.hex(n)).alias(n) if n in ("edited_sha256", "fingerprint", "edited_fingerprint") else F.col(n) for n in names))
