"""Ranked lexical search by Block-Max WAND over a segmented index.

Documents are cut into segments. A segment keeps, for each term that is asked for, its postings in ascending order of
document, in blocks of ``BLOCK`` postings. A block is compressed (gaps and frequencies, each in as few bytes as its
largest value needs) and its last document and its maximum impact lie beside it, uncompressed. A segment is one row of the
index, so a task that is lost costs its own segments, and searches move no postings.

For each query the lists' shallow pointers move over the ends of all blocks, which cuts a segment into stretches within
which no pointer moves; a stretch's bound is the sum of the maxima where the pointers stand. Stretches whose bound falls
short of the k-th best score so far are skipped without decompressing anything. The others are taken in order of their bounds:
lists of the largest maxima are read first, a document goes once its score so far and what the remaining blocks can add fall
short, and the remaining lists' blocks are decompressed only where documents are left. A task keeps the best of each query
over all its segments, so later segments start from a high demand. (Pivots are found for all documents of a stretch by
one array operation instead of a sorted list of cursors per document: the same tests against the same maxima.)

All arithmetic is on whole numbers: a term's weight w, a document's m and a posting's impact
(1000000000 tf) div (1000 tf + 12 m), of which a score is the weighted sum.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.arrowtools import LOWER_ALNUM, limit_batches
from lodeseek.session import materialize

BLOCK = 128
SEGMENT_DOCS = 1 << 14
SEGMENT_POSTINGS = 1 << 22
#: Queries, and bytes of their texts, that one pass over the documents answers.
MAX_ITEMS, MAX_ITEM_BYTES = 20_000, 16 << 20
CACHED_BLOCKS = 16_384
WIDTHS = (np.dtype("<u1"), np.dtype("<u2"), np.dtype("<u4"))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(LOWER_ALNUM).split() if text else []


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all their terms with repeats."""

    documents: int
    tokens: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def length_part(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms."""
        return 75 + (25 * n * self.documents) // self.tokens


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def narrow(values: np.ndarray) -> tuple[int, bytes]:
    """(number of the narrowest width that holds the values, the values in it)."""
    top = int(values.max())
    width = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2
    return width, values.astype(WIDTHS[width]).tobytes()


def pack_block(places: np.ndarray, tf: np.ndarray) -> bytes:
    (a, gaps), (b, times) = narrow(np.diff(places, prepend=0)), narrow(tf)
    return bytes([a * 4 + b]) + gaps + times


def unpack_block(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = WIDTHS[data[0] >> 2], WIDTHS[data[0] & 3]
    places = np.cumsum(np.frombuffer(data, a, n, 1), dtype=np.int64)
    return places, np.frombuffer(data, b, n, 1 + n * a.itemsize).astype(np.int64)


SEGMENT = "ids binary, m binary, terms binary, first_block binary, last_place binary, max_impact binary, data_at binary, postings binary, data binary"
TYPES = {"ids": "<i8", "m": "<i8", "terms": "<i4", "first_block": "<i4", "last_place": "<i4", "max_impact": "<i8", "data_at": "<i8", "postings": "<i4"}


def build_segment(ids: list[int], m: np.ndarray, terms: list[np.ndarray], times: list[np.ndarray], block: int = BLOCK) -> dict:
    """The row of documents whose term numbers and frequencies are given."""
    order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
    ids_sorted, m = np.array(ids, dtype=np.int64)[order], m[order]
    sizes = np.array([len(terms[i]) for i in order], dtype=np.int64)
    place = np.repeat(np.arange(len(order)), sizes)
    term, tf = (np.concatenate([x[i] for i in order]).astype(np.int64) for x in (terms, times))
    by_term = np.lexsort((place, term))
    place, term, tf = place[by_term], term[by_term], tf[by_term]
    impact = impacts(tf, m[place])
    names, starts = np.unique(term, return_index=True)
    ends = np.append(starts[1:], len(term))
    n_blocks = -(-(ends - starts) // block)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    inside = np.arange(first_block[-1]) - np.repeat(first_block[:-1], n_blocks)
    lo = np.repeat(starts, n_blocks) + inside * block
    hi = np.minimum(lo + block, np.repeat(ends, n_blocks))
    data = [pack_block(place[a:b], tf[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]
    out = {
        "ids": ids_sorted, "m": m, "terms": names, "first_block": first_block, "last_place": place[hi - 1], "max_impact": np.maximum.reduceat(impact, lo),
        "data_at": np.concatenate([[0], np.cumsum([len(d) for d in data])]), "postings": hi - lo,
    }
    return {k: v.astype(TYPES[k]).tobytes() for k, v in out.items()} | {"data": b"".join(data)}


class Segment:
    """A row of the index; blocks are decompressed when they are asked for, and the last ones are kept."""

    def __init__(self, row: dict):
        for name, kind in TYPES.items():
            setattr(self, name, np.frombuffer(row[name], kind).astype(np.int64))
        self.data = row["data"]
        self.number = {t: i for i, t in enumerate(self.terms.tolist())}
        self.cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.decompressed = 0

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, impacts) of a block."""
        found = self.cache.get(b)
        if found is None:
            if len(self.cache) >= CACHED_BLOCKS:
                self.cache.pop(next(iter(self.cache)))
            places, tf = unpack_block(self.data[self.data_at[b] : self.data_at[b + 1]], int(self.postings[b]))
            found = self.cache[b] = (places, impacts(tf, self.m[places]))
            self.decompressed += 1
        return found


Best = tuple[np.ndarray, np.ndarray]  #: (scores, ids), best first


def keep_best(best: Best, scores: np.ndarray, ids: np.ndarray, k: int) -> Best:
    scores, ids = np.concatenate([best[0], scores]), np.concatenate([best[1], ids])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def demanded(best: Best, k: int) -> int:
    """The least score that can still count: the k-th best's, whose ties smaller ids win."""
    return int(best[0][k - 1]) if len(best[0]) == k else 1


class ShallowPointers:
    """The lists of a query in a segment, moved over the ends of all their blocks without decompressing any. Between two ends no
    pointer moves, so each stretch of places has one bound: the sum of the maxima of the blocks that the pointers stand at."""

    def __init__(self, segment: Segment, query: list[tuple[int, int]]):
        lists = [(segment.number[t], w) for t, w in query if w > 0 and t in segment.number]
        spans = [(int(segment.first_block[i]), int(segment.first_block[i + 1]), w) for i, w in lists]
        lasts = [segment.last_place[a:b] for a, b, _ in spans]
        self.weights = [w for _, _, w in spans]
        self.ends = np.unique(np.concatenate(lasts)) if lasts else np.zeros(0, np.int64)
        self.blocks = np.full((len(spans), len(self.ends)), -1)
        self.tops = np.zeros((len(spans), len(self.ends)), dtype=np.int64)
        for i, ((a, _, w), last) in enumerate(zip(spans, lasts)):
            reach = int(np.searchsorted(self.ends, last[-1])) + 1  # a list that has ended bounds nothing
            at = np.searchsorted(last, self.ends[:reach]) + a
            self.blocks[i, :reach] = at
            self.tops[i, :reach] = segment.max_impact[at] * w
        self.bounds = self.tops.sum(axis=0)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends


def score_stretches(segment: Segment, lists: ShallowPointers, stretches: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents in these stretches that reach need. Lists come in order of their maxima; documents whose
    score so far and remaining bound fall short go, and blocks of stretches without any document left stay compressed."""
    widths = lists.ends[stretches] - lists.starts[stretches] + 1
    of = np.repeat(stretches, widths)
    places = np.arange(len(of)) - np.repeat(np.cumsum(widths) - widths, widths) + np.repeat(lists.starts[stretches], widths)
    scores = np.zeros(int(lists.ends[-1]) + 1, dtype=np.int64)
    rest, live = lists.bounds.copy(), stretches
    order = np.argsort(-lists.tops.max(axis=1), kind="stable")
    for done, i in enumerate(order, 1):
        needed = np.unique(lists.blocks[i, live])
        needed = needed[needed >= 0].tolist()
        if needed:
            found = [segment.block(b) for b in needed]
            at, impact = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found))
            scores[at] += impact * lists.weights[i]
        rest -= lists.tops[i]
        if done < 3 or done % 4 == 0 or done == len(order):
            kept = scores[places] + rest[of] >= need
            if not kept.all():
                places, of = places[kept], of[kept]
                live = np.unique(of)
                if not len(live):
                    break
    return places, scores[places]


def search_segment(segment: Segment, query: list[tuple[int, int]], best: Best, k: int) -> Best:
    """The k best of what was found so far and of what the segment has for the query's (term number, weight times its repeats)."""
    lists = ShallowPointers(segment, query)
    todo = np.argsort(-lists.bounds, kind="stable")
    at_once = max(1, len(todo) // 16)  # the stretches of the largest bounds first: they raise the demand for the rest
    while len(todo):
        need = demanded(best, k)
        part, todo = todo[:at_once], todo[at_once:]
        part = np.sort(part[lists.bounds[part] >= need])
        if not len(part):
            break
        places, scores = score_stretches(segment, lists, part, need)
        best = keep_best(best, scores, segment.ids[places], k)
        at_once *= 4
    return best


def postings_of(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, times) of each row: its number of terms, and of those asked for their numbers and frequencies."""
    limit_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(1):
                words = terms_of(text.as_py())
                found = Counter(map(number, words))
                found.pop(None, None)
                out[0].append(len(words))
                out[1].append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                out[2].append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "terms", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, "id long, n long, terms binary, times binary")


def document_frequencies(postings: DataFrame, n_terms: int) -> dict[int, int]:
    """Documents that hold each of the terms asked for; a task sends a count per term at most."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    counted = postings.select("terms").mapInArrow(partial, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in counted.collect()}


def build_index(postings: DataFrame, statistics: Statistics, segment_docs: int = SEGMENT_DOCS, block: int = BLOCK) -> DataFrame:
    """A row for each segment of at most segment_docs documents, or of the documents of SEGMENT_POSTINGS postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        n: list[int] = []
        terms: list[np.ndarray] = []
        times: list[np.ndarray] = []
        held = 0

        def made() -> pa.RecordBatch:
            row = build_segment(ids, statistics.length_part(np.array(n, dtype=np.int64)), terms, times, block)
            names = [c.split()[0] for c in SEGMENT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([row[c]], pa.binary()) for c in names], names=names)

        for batch in batches:
            for i, size, t, f in zip(*(batch.column(c).to_pylist() for c in range(4))):
                ids.append(i)
                n.append(size)
                terms.append(np.frombuffer(t, "<i4"))
                times.append(np.frombuffer(f, "<i4"))
                held += len(terms[-1])
                if len(ids) >= segment_docs or held >= SEGMENT_POSTINGS:
                    yield made()
                    ids, n, terms, times, held = [], [], [], [], 0
        if ids:
            yield made()

    # Documents without any of the terms can't be found, nor can those without an id.
    return postings.where("id IS NOT NULL AND length(terms) > 0").mapInArrow(run, SEGMENT)


def search_index(index: DataFrame, queries: dict[int, list[tuple[int, int]]], k: int) -> DataFrame:
    """(item_id, rank, id, score): queries have (term number, weight times repeats)."""
    asked = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for item in asked.value}
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                for item, query in asked.value.items():
                    best[item] = search_segment(segment, query, best[item], k)
        for item, (scores, ids) in best.items():
            columns = [np.full(len(ids), item, dtype=np.int64), ids, scores]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item_id", "id", "score"])

    found = index.mapInArrow(run, "item_id long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, max_items: int = MAX_ITEMS, segment_docs: int = SEGMENT_DOCS, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, id, score): for each item the k documents of the highest score above 0, ties to the smaller id.

    Null and empty texts have no terms; such documents count nowhere, such items find nothing. Rows that repeat an id are
    documents of their own; a document without an id counts in the statistics and is not returned. Items that repeat an
    id are one, the text that sorts first; items without one are left out. Very long texts are read whole. Empty tables: no
    rows. More items than max_items are answered in several passes. Other columns, whatever their names, are not read."""
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("t")).where("item_id IS NOT NULL AND t IS NOT NULL")
    items = materialize(items.groupBy("item_id").agg(F.min("t").alias("t")), "lexical")
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    passes = max(1, -(-n // max_items), -(-(size or 0) // MAX_ITEM_BYTES))
    found = None
    for part in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == part) if passes > 1 else items
        counts = {r.item_id: Counter(terms_of(r.t)) for r in own.collect()}
        terms = sorted({t for c in counts.values() for t in c})
        number = {t: i for i, t in enumerate(terms)}
        postings = materialize(postings_of(docs, terms, id_col, text_col), "lexical")
        total = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        statistics = Statistics(total[0], total[1] or 0)
        df = document_frequencies(postings, len(terms))
        queries = {i: [(number[t], times * statistics.weight(df[number[t]])) for t, times in c.items() if number[t] in df] for i, c in counts.items()}
        index = materialize(build_index(postings, statistics, segment_docs, block), "lexical")
        ranked = search_index(index, queries, k)
        found = ranked if found is None else found.unionByName(ranked)
    return found
