"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The CGK embedding walks a string with a random bit per step and symbol: output j is the symbol under the
walker, which then moves on if bit j of that symbol is set. Strings at a small edit distance get walks
that meet again after an edit, so their outputs differ in few places (Hamming). Here the symbols are
words (ASCII letters and digits in lower case, all other characters of UTF-8 as they are; ASCII
punctuation and space part them), each hashed to 64 bits, whose bits drive the walk.

A walk starts at *every* word of every document, so every item-sized window is embedded, whole texts
included. It likewise starts at every word of every benchmark item from which it ends inside the item.
Each repetition samples the outputs at a few steps of its walk into a key. A window whose key equals an
item's key proposes an alignment. Where a window is proposed for many items (they share a passage, such as the
words of a prompt), the items' words are first looked up in the window, all at once: at most as many may lack as edits
are allowed. Myers' bit-parallel algorithm then checks exactly: the item against
the best matching span near it. A span within ``max_edit_share`` of the item's words is reported.

A walk of some length fits items of some length, so items have classes (``classes``): the longer the items, the more steps
and samples. Every item has keys of its class's walks. All classes share the same walks; a shorter one's keys are sampled from
the first steps. Items of under ``exact_below_words`` words have further keys as a safeguard: with at most k words
edited, one of k + 1 pieces of the item is whole, so the first words of each piece are a key, and every window starts a run of
as many words. Walks alone find at least 0.9 of edited items of each class from four words on (tested); with the further keys
every span of a short item within ``max_edit_share`` is found, whatever the edits.

The benchmark is broadcast as key arrays, after its size was checked (``max_items``, ``max_item_bytes``). Nothing else is
gathered: documents are read once, in blocks, with no shuffle before the few hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.arrowtools import LOWER_ALNUM, limit_batches, texts_of

SYMBOL_SEED = 11


@dataclass(frozen=True)
class Settings:
    walks: int = 3
    #: (words from which on, steps, samples) of each class of items, the longest first.
    classes: tuple[tuple[int, int, int], ...] = ((30, 18, 6), (10, 12, 4), (1, 5, 3))
    keys_per_walk: int = 2
    max_edit_share: float = 0.2
    min_item_words: int = 1
    exact_below_words: int = 30
    max_items: int = 200_000
    max_item_bytes: int = 256 << 20
    block_words: int = 49_152
    filter_bits: int = 21


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_ALNUM).split()


def symbols_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SYMBOL_SEED)), dtype=np.uint64, count=len(words))


@lru_cache(maxsize=8)
def plan(s: Settings) -> list[tuple[np.uint64, list[tuple[int, frozenset[int]]]]]:
    """For each walk a multiplier that gives its bits, and the class and sampled steps of each of its keys."""
    rng = np.random.RandomState(20240501)
    out = []
    for _ in range(s.walks):
        odd, keys = np.uint64(rng.randint(1, 1 << 62) * 2 + 1), []
        for c, (_, steps, samples) in enumerate(s.classes):
            edges = np.linspace(0, steps, samples + 1).astype(int)  # one sample in each stretch, so that they see distinct words
            keys += [(c, frozenset(int(rng.randint(a, b)) for a, b in zip(edges[:-1], edges[1:]))) for _ in range(s.keys_per_walk)]
        out.append((odd, keys))
    return out


def class_of(words: int, s: Settings) -> int:
    """The first class that takes items of so many words; the last takes what is left."""
    return next((c for c, (least, _, _) in enumerate(s.classes) if words >= least), len(s.classes) - 1)


def walk_keys(symbols: np.ndarray, s: Settings, classes: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, a key for a walk from each symbol, where each walk of that class's steps ended). Symbol 0 stops a walk."""
    n = len(symbols)
    mix = np.uint64(0x9E3779B97F4A7C15)
    last = max((s.classes[c][1] for c in classes), default=0)
    for w, (odd, sampled) in enumerate(plan(s)):
        moves = symbols * odd
        moves ^= moves >> np.uint64(29)
        moves[symbols == 0] = 0
        at, ends = np.arange(n), {}
        keys = {k: np.full(n, np.uint64(w * 7919 + k + 1)) for k, (c, _) in enumerate(sampled) if c in classes}
        now, step = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
        one = np.uint64(1)
        for j in range(last):
            here = [k for k in keys if j in sampled[k][1]]
            if here:
                np.take(symbols, at, out=now, mode="clip")
            for k in here:
                keys[k] *= mix
                keys[k] ^= now
            np.take(moves, at, out=step, mode="clip")
            step >>= np.uint64(j)
            step &= one
            at += step.view(np.int64)
            ends |= {c: at.copy() for c in classes if s.classes[c][1] == j + 1}
        for k, key in keys.items():
            key *= mix
            key ^= key >> np.uint64(31)
            yield sampled[k][0], key, ends[sampled[k][0]]


def piece_length(words: int, s: Settings) -> int:
    """The words of the shortest of the pieces of an item, one more than its words that may be edited."""
    return max(1, words // (int(s.max_edit_share * words) + 1))


def run_keys(symbols: np.ndarray, length: int) -> np.ndarray:
    """A key for the run of so many words from each symbol; the last symbol is 0, which no item has."""
    at = np.arange(len(symbols))
    key = np.full(len(symbols), np.uint64(0xA5A5A5A5 + length))
    for j in range(length):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
        key ^= np.take(symbols, at + j, mode="clip")
    key *= np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(31))


def document_keys(symbols: np.ndarray, items: Items, s: Settings) -> Iterator[np.ndarray]:
    """Every kind of key that the items have, from each symbol."""
    for _, key, _ in walk_keys(symbols, s, items.walked):
        yield key
    for length in items.runs:
        yield run_keys(symbols, length)


@dataclass
class Items:
    """The benchmark's words and keys: sorted keys with the item and word offset that each stands for; the classes of
    its walks, and the lengths of runs that are keys."""

    ids: list[int]
    words: list[list[bytes]]
    symbols: np.ndarray
    first: np.ndarray  # of each item, among the symbols
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    bloom: np.ndarray
    walked: set[int]
    runs: list[int]


def build_items(rows: list[tuple[int, str | None]], s: Settings) -> Items:
    ids, words, keys, item, offset, flat = [], [], [], [], [], []
    walked, runs = set(), set()
    for item_id, text in rows:
        parts = words_of((text or "").encode())
        if item_id is None or len(parts) < s.min_item_words:
            continue
        n = len(parts)
        symbols = np.concatenate([symbols_of(parts), np.zeros(1, dtype=np.uint64)])
        found = []
        own = class_of(n, s)
        walked.add(own)
        for _, key, end in walk_keys(symbols, s, {own}):
            # Walks that end on the item's own words; of an item too short for any, the walks from its first words.
            good = np.flatnonzero(end[:n] < n)
            found.append((key, good if len(good) else np.arange(min(2, n))))
        if n < s.exact_below_words:
            pieces, length = int(s.max_edit_share * n) + 1, piece_length(n, s)
            starts = np.unique([i * n // pieces for i in range(pieces)])
            found.append((run_keys(symbols, length), starts))
            runs.add(length)
        for key, good in found:
            keys.append(key[good])
            item.append(np.full(len(good), len(ids)))
            offset.append(good)
        ids.append(int(item_id))
        words.append(parts)
        flat.append(symbols[:n])
    all_keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
    order = np.argsort(all_keys, kind="stable")
    bloom = np.zeros(1 << s.filter_bits, dtype=bool)
    bloom[all_keys >> np.uint64(64 - s.filter_bits)] = True
    cat = lambda parts: np.concatenate(parts)[order] if parts else np.zeros(0, dtype=np.int64)
    first = np.cumsum([0, *map(len, words)])
    return Items(ids, words, np.concatenate([*flat, np.zeros(0, np.uint64)]), first, all_keys[order], cat(item), cat(offset), bloom, walked, sorted(runs))


def best_span(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """(least edit distance of pattern to any span of text, end of the first such span): Myers 1999 on words."""
    m = len(pattern)
    masks: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


#: From so many candidates at one place of a document, items' words are looked up first.
MANY = 16
NEAR_PLACES = 16


def likely(items: Items, candidates: np.ndarray, window: np.ndarray, s: Settings) -> np.ndarray:
    """Which candidate items have in the window (symbols) all but as many words as may be edited: each edit takes one word at most."""
    first = items.first[candidates]
    n = items.first[candidates + 1] - first
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    there = np.isin(items.symbols[at], window).astype(np.int64)
    return np.add.reduceat(there, np.cumsum(n) - n) >= n - (s.max_edit_share * n).astype(np.int64)


def distinct(columns: np.ndarray) -> np.ndarray:
    """The distinct columns of a matrix of three rows, in order of the first row, then the second, then the third."""
    columns = columns[:, np.lexsort(columns[::-1])]
    return columns[:, np.concatenate([[True], (columns[:, 1:] != columns[:, :-1]).any(axis=0)])] if columns.shape[1] else columns


def scan(texts: list[bytes], items: Items, s: Settings) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, edits, first word, end word): the best span of each text and item, whole texts.
    Of spans with equally few edits the first counts."""
    parts = [words_of(t) for t in texts]
    hits: list[np.ndarray] = []
    longest = int((items.first[1:] - items.first[:-1]).max()) if items.ids else 0
    at = 0
    while at < len(parts):
        # A block of whole documents; a document longer than a block is one block of its own.
        end, n = at, 0
        while end < len(parts) and (end == at or n + len(parts[end]) <= s.block_words):
            n += len(parts[end]) + 1
            end += 1
        flat: list[bytes] = []
        starts = np.zeros(end - at + 1, dtype=np.int64)
        for i in range(at, end):
            flat += parts[i]
            flat.append(b"")
            starts[i - at + 1] = len(flat)
        symbols = symbols_of(flat)
        symbols[starts[1:] - 1] = 0
        found: list[np.ndarray] = []  # rows of (document, place in the block, item) with the place where the item would start
        for key in document_keys(symbols, items, s):
            maybe = np.flatnonzero(items.bloom[key >> np.uint64(64 - s.filter_bits)])
            low = np.searchsorted(items.keys, key[maybe], "left")
            n_hit = np.searchsorted(items.keys, key[maybe], "right") - low
            maybe, low, n_hit = maybe[n_hit > 0], low[n_hit > 0], n_hit[n_hit > 0]
            if len(maybe):
                q = np.repeat(low - (np.cumsum(n_hit) - n_hit), n_hit) + np.arange(n_hit.sum())
                place = np.repeat(maybe, n_hit) - items.offset[q]
                doc = np.repeat(np.searchsorted(starts, maybe, "right") - 1, n_hit)
                found.append(distinct(np.stack([doc, place, items.item[q]])))
        if found:
            doc, place, item = distinct(np.concatenate(found, axis=1))
            near = place // NEAR_PLACES  # neighbouring places are judged at once, in one window around all of them
            group = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (near[1:] != near[:-1])]))
            keep = np.ones(len(doc), dtype=bool)
            for lo, hi in zip(group, np.append(group[1:], len(doc))):
                if hi - lo > MANY:
                    slack = int(s.max_edit_share * longest) + 2
                    window = symbols[max(starts[doc[lo]], place[lo] - slack) : max(0, min(starts[doc[lo] + 1], place[hi - 1] + longest + slack))]
                    own, of = np.unique(item[lo:hi], return_inverse=True)
                    keep[lo:hi] = likely(items, own, window, s)[of]
            hits.append(np.stack([doc + at, item, place - starts[doc]])[:, keep])
        at = end
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    last: tuple[int, int, int] = (-1, -1, 0)
    for doc, item, start in distinct(np.concatenate(hits, axis=1)).T.tolist() if hits else ():
        pattern = items.words[item]
        slack = int(s.max_edit_share * len(pattern))
        if last[:2] == (doc, item) and start - last[2] <= 1:
            continue  # sorted: the span from the start before covers this one
        last = (doc, item, start)
        lo = max(0, start - slack)
        span = parts[doc][lo : max(0, start) + len(pattern) + slack + 2]
        edits, stop = best_span(pattern, span)
        if edits <= slack:
            back, length = best_span(pattern[::-1], span[:stop][::-1])
            found_span = (edits, lo + stop - length, lo + stop)
            if (doc, item) not in best or found_span < best[(doc, item)]:
                best[(doc, item)] = found_span
    return [(doc, item, *found_span) for (doc, item), found_span in sorted(best.items())]


def shared_items(benchmark: DataFrame, s: Settings, item_col: str, item_text_col: str) -> Broadcast:
    """The benchmark's keys, broadcast once its number of items is known to be within bounds."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if n > s.max_items or size > s.max_item_bytes:
        raise ValueError(f"the benchmark has over {s.max_items} items or {s.max_item_bytes} bytes; raise the limits if executors have the memory")
    rows = rows.collect()
    return spark.sparkContext.broadcast(build_items(sorted((r.i, r.t) for r in rows if r.i is not None and r.t is not None), s))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, item_id, edits, item_words, first_word, end_word, similarity): the best verified span of each document and item.

    Null and empty texts leak nothing. Items without words (or of under min_item_words words), with a null id or text are not
    searched. Repeated rows are judged each on its own and return a row each, and so do repeated items; of spans with equally
    few edits the first counts. Very long texts are a block of their own, searched whole. An empty table, or an empty
    benchmark, returns no rows. Other columns of either table, whatever their names, are not read."""
    spark = docs.sparkSession
    shared = shared_items(benchmark, settings, item_col, item_text_col)
    schema = "id long, item_id long, edits int, item_words int, first_word int, end_word int, similarity double"
    limit_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            ids = batch.column("id").to_pylist()
            found = scan(texts_of(batch, "_t"), items, settings) if items.ids else []
            out = {
                "id": pa.array([ids[d] for d, *_ in found], pa.int64()),
                "item_id": pa.array([items.ids[i] for _, i, *_ in found], pa.int64()),
                "edits": pa.array([e for _, _, e, *_ in found], pa.int32()),
                "item_words": pa.array([len(items.words[i]) for _, i, *_ in found], pa.int32()),
                "first_word": pa.array([f[3] for f in found], pa.int32()),
                "end_word": pa.array([f[4] for f in found], pa.int32()),
                "similarity": pa.array([1 - f[2] / len(items.words[f[1]]) for f in found], pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t")).mapInArrow(run, schema)


def leaks_column(benchmark: DataFrame, settings: Settings = Settings(), item_col: str = "item_id", item_text_col: str = "text") -> Callable[[Column], Column]:
    """Whether a text has a verified span of any item, as a function of a text column; null texts have none."""
    shared = shared_items(benchmark, settings, item_col, item_text_col)
    limit_batches(benchmark.sparkSession)

    @F.arrow_udf("boolean")
    def leaks(text: pa.Array) -> pa.Array:
        items = shared.value
        values = [b"" if t is None else t for t in text.cast(pa.large_binary()).to_pylist()]
        hit = {found[0] for found in scan(values, items, settings)} if items.ids else set()
        return pa.array([i in hit for i in range(len(values))], pa.bool_())

    return leaks
