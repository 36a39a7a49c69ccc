"""A stored keyword index whose searches stop early: postings in blocks that carry what bounds their scores.

A document lies in one *segment*, some 64 documents of about one length, and a block holds a term's postings in one
segment, with the largest frequency and the smallest length among them. So bounds of a segment add up over the terms of
a query without any join of document ranges, and the scores of a segment are whole once its blocks are opened. A search

1. sums the blocks' bounds by segment, reading no postings (columns of the table that Parquet leaves unread),
2. opens the segments of the highest bounds; the k-th score there is a threshold that the answer reaches,
3. opens only segments whose bound reaches that threshold.

The answer is that of a full scan. Blocks are partitioned by a hash of the term, so a query opens the folders of its
words, and sorted by term and segment inside files. A change appends blocks of a later epoch and notes which documents'
older postings are dead, in which segments; document frequencies are corrected by opening these segments alone. Once the
dead are a quarter of the documents, or documents have doubled, the blocks are laid out anew, from the documents' terms
and their frequencies, which are stored beside the blocks: no text is split twice and no posting is shuffled by itself.

Ids are unique and not null (``create`` and ``replace`` raise otherwise). Null texts are empty; a document without a
token counts and is never found."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.arrow_text import counts, lowered, ranked, slices, token_codes, widths
from lodeseek.operators.bm25 import Params, query_terms
from lodeseek.session import freed_shuffles, materialize, shuffle_partitions_for
from lodeseek.sources.store import Store

#: Length classes are powers of two; no text has 2^48 tokens.
CLASSES = 48
#: Text that a task splits at once; it makes blocks of an eighth as many postings.
SLICE_BYTES = 8 << 20


@dataclass
class KeywordIndex:
    store: Store
    name: str = "keyword"
    segment_docs: int = 64
    bucket_tokens: int = 1_000_000  # a folder for so many tokens, between 8 and 4096 folders
    lane_documents: int = 8_000_000  # as many postings of a term are written by one task
    first_segments: int = 32  # opened for the threshold
    literal_segments: int = 1000  # so many are named in the plan, more are joined
    opened: dict = field(default_factory=dict)  # of the last search: segments with a word of the query, and those it opened

    # Layout

    def _table(self, kind: str) -> DataFrame:
        return self.store.read(f"{self.name}_{kind}")

    def exists(self) -> bool:
        return self.store.exists(f"{self.name}_state")

    def _state(self):
        return self._table("state").first()

    def _segment(self, doc_id: Column, length: Column, segments: list[int]) -> Column:
        """The segments of a class follow those of shorter texts; a document's is the hash of its id there."""
        starts = [sum(segments[:i]) for i in range(CLASSES)]
        at = F.least(F.floor(F.log2(length + 1)), F.lit(CLASSES - 1)).cast("int")
        pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at + 1).cast("long")
        return pick(starts) + F.pmod(F.xxhash64(doc_id), pick(segments))

    def _layout(self, lengths: DataFrame) -> list[int]:
        at = F.least(F.floor(F.log2(F.col("length") + 1)), F.lit(CLASSES - 1)).cast("int")
        found = {r.c: r.n for r in lengths.groupBy(at.alias("c")).agg(F.count("*").alias("n")).collect()}  # a row for each class
        return [max(1, math.ceil(found.get(c, 0) / self.segment_docs)) for c in range(CLASSES)]

    def _checked(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(doc_id, length, terms, frequencies): the number of tokens, the different ones and how often each occurs. Terms are
        one string, with spaces between, as no token holds one: arrays of strings take more time and room in the JVM."""
        ids = docs.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("d")).first()
        if ids.n != ids.d:
            raise ValueError(f"{ids.n} rows have {ids.d} different ids that are not null")
        rows = docs.select(F.col(id_col).alias("doc_id"), lowered(F.col(text_col)).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, SLICE_BYTES):
                    row, code, known = token_codes(part.column("text"))
                    length = np.bincount(row, minlength=part.num_rows)
                    row, code, n = counts(row, code, len(known))
                    ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                    terms = pc.binary_join(pa.ListArray.from_arrays(ends, known.take(pa.array(code))), " ")
                    columns = [part.column("doc_id"), pa.array(length, pa.int64()), terms, pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "length", "terms", "frequencies"])

        return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, length long, terms string, frequencies array<int>")

    def _blocks_of_texts(self, rows: DataFrame, segments: list[int], buckets: int, documents: int, n_tokens: int, epoch: int) -> DataFrame:
        """Documents with their terms, as _checked() has them, are shuffled by segment, so a task makes a segment's blocks where
        its documents lie, and blocks are shuffled, not postings. A segment that a slice ends in has two blocks of a term.

        Blocks come sorted by term from each slice, and a bucket has tasks of its own, so these merge sorted runs."""
        placed = rows.withColumn("segment", self._segment(F.col("doc_id"), F.col("length"), segments))
        placed = placed.repartition(shuffle_partitions_for(self.store.spark, 8 * n_tokens), "segment").sortWithinPartitions("segment", "doc_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, SLICE_BYTES, 8 * widths(batch.column("frequencies"))):
                    row = np.repeat(np.arange(part.num_rows), widths(part.column("frequencies")))
                    if not len(row):
                        continue
                    terms = pc.split_pattern(part.column("terms"), " ").flatten()
                    code, known = ranked(terms.filter(pc.not_equal(terms, "")))  # a document without tokens is split into ""
                    n, length = part.column("frequencies").flatten().to_numpy().astype(np.int64), part.column("length").to_numpy()
                    own, at = np.unique(part.column("segment").to_numpy(), return_inverse=True)
                    key = code * len(own) + at[row]
                    order = np.argsort(key, kind="stable")  # by term and segment, then as rows come: by id
                    row, n, key = row[order], n[order], key[order]
                    length = length[row]
                    starts = np.flatnonzero(np.diff(key, prepend=-1))
                    ends = np.append(starts, len(row))
                    entries = pa.StructArray.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(n), pa.array(length)], names=["doc_id", "frequency", "length"])
                    columns = [own[key[starts] % len(own)], np.diff(ends), np.maximum.reduceat(n, starts), np.minimum.reduceat(length, starts)]
                    columns = [known.take(pa.array(key[starts] // len(own))), *(pa.array(c, pa.int64()) for c in columns), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)]
                    yield pa.RecordBatch.from_arrays(columns, names=["term", "segment", "n", "max_frequency", "min_length", "entries"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        schema = f"term string, segment long, n long, max_frequency long, min_length long, entries array<struct<doc_id: {kind}, frequency: long, length: long>>"
        # A lane holds at most so many postings of a term, so a word of every document is dealt to many tasks.
        lanes = max(1, math.ceil(documents / self.lane_documents))
        tasks = min(buckets * lanes, max(1, math.ceil(documents / self.segment_docs)))
        blocks = placed.mapInArrow(run, schema).withColumn("bucket", self._bucket(buckets))
        lane = F.pmod("segment", F.lit(lanes)).cast("int")
        blocks = blocks.repartitionById(tasks, F.pmod(F.col("bucket") * lanes + lane, F.lit(tasks)).cast("int"))
        return blocks.withColumn("epoch", F.lit(epoch).cast("long")).sortWithinPartitions("bucket", "term", "segment")

    def _put_state(self, documents: int, n_tokens: int, epoch: int, buckets: int, laid_out: int, segments: list[int]) -> None:
        schema = "documents long, tokens long, epoch long, buckets int, laid_out long, segments array<long>"
        self.store.write(f"{self.name}_state", self.store.spark.createDataFrame([(documents, n_tokens, epoch, buckets, laid_out, segments)], schema))

    def _write_all(self, rows: DataFrame) -> None:
        """All tables of documents and their terms, as _checked() has them, which are stored first and then read for the rest."""
        with self.store.transaction():
            self.store.write(f"{self.name}_terms", rows)
            rows = self._table("terms")
            lengths = rows.select("doc_id", "length")
            segments = self._layout(lengths)
            total = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
            buckets = min(4096, max(8, math.ceil(total.t / self.bucket_tokens)))
            placed = lengths.withColumn("segment", self._segment(F.col("doc_id"), F.col("length"), segments))
            self.store.write(f"{self.name}_docs", placed)
            with freed_shuffles(self.store.spark):
                self.store.write(f"{self.name}_blocks", self._blocks_of_texts(rows, segments, buckets, total.n, total.t, 0), ["term", "segment"], "bucket", as_is=True)
            self.store.write(f"{self.name}_gone", placed.select("doc_id", "segment", F.lit(0).cast("long").alias("epoch")).limit(0))
            self._put_state(total.n, total.t, 0, buckets, total.n, segments)

    def create(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._write_all(self._checked(docs, id_col, text_col))

    # Changes

    def replace(self, docs: DataFrame, gone: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        """docs in place of their old entries, and of those of the ids (doc_id) that are gone. What is written is as large as the
        change, but where the blocks are laid out anew."""
        rows = materialize(self._checked(docs, id_col, text_col), "terms")
        with self.store.transaction():
            state = self._state()
            epoch = state.epoch + 1
            lengths = rows.select("doc_id", "length")
            ids = lengths.select("doc_id") if gone is None else lengths.select("doc_id").union(gone.select("doc_id"))
            known = self._table("docs")
            old = known.join(ids.distinct(), "doc_id", "left_semi")
            minus = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
            plus = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
            documents = state.documents - minus.n + plus.n
            if not self.store.exists(f"{self.name}_terms"):
                self.store.write(f"{self.name}_terms", self._terms_of_blocks())
            self.store.change(f"{self.name}_terms", rows, ids, ["doc_id"])
            if 4 * (self._table("gone").count() + minus.n) > documents or documents > 2 * max(state.laid_out, self.segment_docs):
                return self.lay_out()
            dead = old.select("doc_id", "segment", F.lit(epoch).cast("long").alias("epoch"))
            placed = lengths.select("doc_id", "length", self._segment(F.col("doc_id"), F.col("length"), state.segments).alias("segment"))
            self.store.change(f"{self.name}_gone", dead, None, ["doc_id"])
            self.store.change(f"{self.name}_docs", placed, ids, ["doc_id"])
            blocks = self._blocks_of_texts(rows, state.segments, state.buckets, plus.n, plus.t, epoch)
            with freed_shuffles(self.store.spark):
                self.store.change(f"{self.name}_blocks", blocks, None, ["term"], as_is=True)
            self._put_state(documents, state.tokens - minus.t + plus.t, epoch, state.buckets, state.laid_out, state.segments)

    def delete(self, ids: DataFrame) -> None:
        """ids (doc_id); those that are not there change nothing."""
        none = ids.select("doc_id", F.lit(None).cast("string").alias("text")).limit(0)
        self.replace(none, ids)

    def lay_out(self) -> None:
        """Blocks of the living documents alone, in segments for the number of documents there are now."""
        self._write_all(self._table("terms") if self.store.exists(f"{self.name}_terms") else self._terms_of_blocks())

    def _terms_of_blocks(self) -> DataFrame:
        """What _checked() has, for an index that was stored before terms were: every living posting is shuffled, once."""
        found = self._living(self._table("blocks")).groupBy("doc_id").agg(F.collect_list(F.struct("term", "frequency")).alias("found"))
        rows = self._table("docs").select("doc_id", "length").join(found, "doc_id", "left")
        terms, n = F.coalesce(F.array_join("found.term", " "), F.lit("")), F.coalesce(F.col("found.frequency").cast("array<int>"), F.array().cast("array<int>"))
        return rows.select("doc_id", "length", terms.alias("terms"), n.alias("frequencies"))

    # Searches

    def _gone(self) -> DataFrame:
        return self._table("gone").groupBy("doc_id").agg(F.max("epoch").alias("gone_epoch")).withColumnRenamed("doc_id", "gone_id")

    def _living(self, blocks: DataFrame, changed: bool = True) -> DataFrame:
        """(term, segment, doc_id, frequency, length) of blocks, without postings of documents that changed or went later."""
        rows = blocks.select("term", "segment", "epoch", F.inline("entries"))
        if not changed:
            return rows
        gone = self._gone()
        return rows.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("epoch") < F.col("gone_epoch")), "left_anti")

    def _blocks(self, buckets: dict[str, int]) -> DataFrame:
        """The words and their folders are literals, so they reach the scan."""
        return self._table("blocks").where(F.col("bucket").isin(sorted(set(buckets.values()))) & F.col("term").isin(list(buckets)))

    def blocks_of_terms(self, terms: list[str]) -> DataFrame:
        rows = self.store.spark.createDataFrame([(t,) for t in terms], "term string")
        return self._blocks({r.term: r.b for r in rows.select("term", self._bucket(self._state().buckets).alias("b")).collect()})

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")

    def _frequency(self, blocks: DataFrame, changed: bool) -> dict[str, int]:
        """Documents that hold each word: counts of blocks; segments with dead postings are opened and counted."""
        if not changed:
            return {r.term: r.n for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        dirty = self._table("gone").select("segment").distinct()
        marked = blocks.join(dirty.withColumn("dirty", F.lit(True)), "segment", "left")
        clean = marked.where("dirty IS NULL").select("term", "n")
        opened = self._living(blocks.join(dirty, "segment", "left_semi")).groupBy("term").agg(F.count("*").alias("n"))
        rows = clean.unionByName(opened).groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each word of the query
        return {r.term: r.n for r in rows}

    def search(self, query: str, k: int = 10, params: Params = Params()) -> DataFrame:
        """The k best (doc_id, score), ties by id; a query without tokens has no rows. Scores are bm25.search()'s."""
        state = self._state()
        found = query_terms(self.store.spark, query).withColumn("b", self._bucket(state.buckets)).collect()
        words, changed = {r.term: r.qn for r in found}, state.epoch > 0
        blocks = self._blocks({r.term: r.b for r in found})
        frequency = self._frequency(blocks, changed) if words else {}
        mean = state.tokens / state.documents if state.documents else 0.0
        weights = {t: words[t] * math.log((state.documents - n + 0.5) / (n + 0.5) + 1) for t, n in frequency.items() if n}
        if not weights or k < 1:
            return self._table("docs").select("doc_id", F.lit(0.0).alias("score")).limit(0)
        weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("term"))

        def part(tf: Column, length: Column) -> Column:
            return weight * (tf * (params.k1 + 1)) / (tf + params.k1 * (1 - params.b + params.b * length / mean))

        blocks = blocks.where(F.col("term").isin(list(weights)))
        bounds = blocks.groupBy("segment", "term").agg(F.max(part(F.col("max_frequency"), F.col("min_length"))).alias("bound"))
        bounds = bounds.groupBy("segment").agg((F.sum("bound") * (1 + 1e-9)).alias("bound"))  # sums of doubles hang on their order

        def scores(chosen: DataFrame) -> DataFrame:
            rows = self._living(chosen, changed).select("doc_id", part(F.col("frequency"), F.col("length")).alias("part"))
            return rows.groupBy("doc_id").agg(F.sum("part").alias("score"))

        top = bounds.orderBy(F.desc("bound"), "segment").limit(max(self.first_segments, self.literal_segments) + 1).collect()
        first, least = [r.segment for r in top[: self.first_segments]], 0.0
        if len(top) > len(first):
            best = scores(blocks.where(F.col("segment").isin(first))).orderBy(F.desc("score")).limit(k).collect()
            least = best[-1].score * (1 - 1e-9) if len(best) == k else 0.0
        named = [r.segment for r in top if r.bound >= least]
        few = len(named) <= self.literal_segments
        self.opened = {"first": len(first), "opened": len(named) if few else None}
        kept = bounds.where(F.col("bound") >= least).select("segment")
        chosen = blocks.where(F.col("segment").isin(named)) if few else blocks.join(kept, "segment", "left_semi")
        return scores(chosen).orderBy(F.desc("score"), "doc_id").limit(k)
