"""Latent vectors of texts: words that keep the same company come to lie close, so a query finds texts that share no word with it.

The matrix of documents by terms (tf-idf, rows of unit length) is never moved: documents stay where Spark holds them. A
randomised range finder multiplies it with a few random columns, and subspace rounds with itself; each is one pass in which
a task sends the sums of the terms that it saw. The tall matrix of all documents' products is factorised by a tall-skinny
QR: tasks reduce their rows to one small triangle, triangles are stacked and reduced again, level by level. The small
triangle's singular vectors turn the columns into the right singular vectors of the whole.

The vocabulary is bounded by a parameter (``max_terms``, the terms of most documents), whatever the corpus; only
matrices of that many rows are broadcast or reach the driver. Counts, document frequencies and products cover all documents.

Texts are lower-cased in the JVM and split where they lie, by Arrow in tasks: of a text only its terms' numbers and weights are
written, and of a corpus only sums for each term are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.arrow_text import counts, lowered, slices, split, token_codes
from lodeseek.functions.text import STOP_WORDS, TOKEN_BREAK
from lodeseek.operators import bm25
from lodeseek.session import materialize

_BREAK = re.compile(re.sub(r"\\x\{(\w{4})\}", r"\\u\1", TOKEN_BREAK))
#: Text that a task splits at once, and documents of a dense block.
SLICE_BYTES, BLOCK_ROWS = 2 << 20, 64
#: Tasks of one pass, each of which sends sums at most once: a few for every core, not one for every split of a large corpus.
TASKS_PER_CORE = 2
#: Triangles that one task stacks.
FAN_IN = 64


@dataclass(frozen=True)
class Settings:
    dimensions: int = 64
    extra: int = 16  # columns beyond the dimensions that the range finder carries
    rounds: int = 3
    min_documents: int = 2
    max_terms: int = 20_000
    seed: int = 1


def vocabulary(tokens: DataFrame, total: int, settings: Settings) -> list[tuple[str, float]]:
    """(term, idf) of the terms of most documents, at most max_terms, in order of the terms."""
    return _most_frequent(tokens.groupBy("term").agg(F.count("*").alias("df")), total, settings)


def _most_frequent(df: DataFrame, total: int, settings: Settings) -> list[tuple[str, float]]:
    rows = df.where(F.col("df") >= settings.min_documents).orderBy(F.desc("df"), "term").limit(settings.max_terms).collect()
    return sorted((r.term, math.log((1 + total) / (1 + r.df)) + 1) for r in rows)


def document_rows(tokens: DataFrame, terms: Sequence[tuple[str, float]]) -> DataFrame:
    """(doc_id, terms, weights): a sparse row of unit length for each document that holds a term of the vocabulary."""
    spark = tokens.sparkSession
    known = spark.createDataFrame([(t, i, w) for i, (t, w) in enumerate(terms)], "term string, n int, idf double")
    weight = (1 + F.log(F.col("frequency"))) * F.col("idf")
    rows = tokens.join(F.broadcast(known), "term").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("n", weight.alias("w")))).alias("row"), F.sqrt(F.sum(weight * weight)).alias("size")
    )
    return rows.select("doc_id", F.col("row.n").alias("terms"), F.transform("row", lambda x: x["w"] / F.col("size")).alias("weights"))


def _lower(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), lowered(F.col(text_col)).alias("text"))


def _known(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, frequency) of the known terms of lower-cased texts."""
    row, pieces = split(texts)
    number = pc.fill_null(pc.index_in(pieces, value_set=terms), -1).to_numpy(zero_copy_only=False)
    kept = number >= 0
    return counts(row[kept], number[kept].astype(np.int64), len(terms))


def document_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df) of documents of different ids; the row without a term counts the documents that have any. Tasks count a slice of
    texts each, so that a row for each different term of a slice is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                row, code, known = token_codes(part.column("text"))
                df = np.bincount(counts(row, code, len(known))[1], minlength=len(known))
                found = pa.concat_arrays([known, pa.array([None], pa.string())])
                yield pa.RecordBatch.from_arrays([found, pa.array(np.append(df, len(np.unique(row))), pa.int64())], names=["term", "df"])

    return _lower(docs, id_col, text_col).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def text_rows(docs: DataFrame, terms: Sequence[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """document_rows() of documents of different ids, made where their texts lie."""
    sent = docs.sparkSession.sparkContext.broadcast(([t for t, _ in terms], np.array([w for _, w in terms])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = pa.array(sent.value[0], pa.string()), sent.value[1]
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                row, term, n = _known(part.column("text"), names)
                weight = (1 + np.log(n)) * idf[term]
                size = np.sqrt(np.bincount(row, weight * weight, part.num_rows))
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                offsets = pa.array(np.append(starts, len(row)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (term.astype(np.int32), weight / size[row])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row[starts])), *lists], names=["doc_id", "terms", "weights"])

    texts = _lower(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, terms array<int>, weights array<double>")


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each entry, its term, its weight)."""
    lists = batch.column("terms")
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), batch.column("weights").flatten().to_numpy()


def _blocks(row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, terms that occur, dense weights of these) of few rows each; entries come in order of their rows."""
    for first in range(0, n_rows, BLOCK_ROWS):
        to = min(first + BLOCK_ROWS, n_rows)
        at = slice(*np.searchsorted(row, (first, to)))
        used = np.flatnonzero(np.bincount(term[at]))
        dense = np.zeros((to - first, len(used)))
        dense[row[at] - first, np.searchsorted(used, term[at])] = weight[at]
        yield first, used, dense


def _few_tasks(df: DataFrame) -> DataFrame:
    return df.coalesce(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def gram_product(rows: DataFrame, columns: np.ndarray) -> np.ndarray:
    """Transposed rows times rows times columns: one pass; tasks send the sums of the terms that they saw, added per term."""
    sent = rows.sparkSession.sparkContext.broadcast(columns)
    width = columns.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, total = sent.value, np.zeros(sent.value.shape)
        for batch in batches:
            for _, used, dense in _blocks(*_sparse(batch), batch.num_rows):
                total[used] += dense.T @ (dense @ columns[used])
        seen = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(seen), 4096):
            part = seen[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.FixedSizeListArray.from_arrays(pa.array(total[part].ravel()), width).cast(pa.list_(pa.float64()))], names=["n", "v"])

    partial = _few_tasks(rows.select("terms", "weights")).mapInArrow(run, "n long, v array<double>")
    summed = partial.groupBy("n").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(width))).alias("v")).toArrow()
    out = np.zeros(columns.shape)
    if summed.num_rows:
        out[summed.column("n").to_numpy()] = np.stack(summed.column("v").to_numpy())
    return out


def triangle(rows: DataFrame, columns: np.ndarray) -> np.ndarray:
    """The triangular factor of rows times columns, by a tree of tall-skinny QR."""
    sent, width = rows.sparkSession.sparkContext.broadcast(columns), columns.shape[1]
    schema = "g long, r binary"

    def reduce(parts: Iterator[np.ndarray]) -> np.ndarray:
        held = np.zeros((0, width))
        for part in parts:
            held = np.linalg.qr(np.vstack([held, part]), mode="r")
        return held

    def result(g: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["g", "r"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        products = lambda b: [dense @ sent.value[used] for _, used, dense in _blocks(*_sparse(b), b.num_rows)]
        yield result(TaskContext.get().partitionId(), reduce(np.vstack(products(b)) for b in batches if b.num_rows))

    def stack(key: tuple, table: pa.Table) -> pa.Table:
        parts = (np.frombuffer(r, np.float64).reshape(-1, width) for r in table.column("r").to_pylist())
        return pa.Table.from_batches([result(key[0].as_py(), reduce(parts))])

    level = _few_tasks(rows.select("terms", "weights")).mapInArrow(leaves, schema)
    n = level.rdd.getNumPartitions()
    while n > 1:
        level = level.withColumn("g", F.expr(f"g DIV {FAN_IN}")).groupBy("g").applyInArrow(stack, schema)
        n = -(-n // FAN_IN)
    found = level.collect()
    return np.frombuffer(found[0].r, np.float64).reshape(-1, width) if found else np.zeros((0, width))


@dataclass(frozen=True)
class LatentModel:
    """Terms with their idf and latent vectors, and the singular values."""

    terms: tuple[str, ...]
    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    def table(self, spark) -> DataFrame:
        """(term, idf, vector), to be stored; a last row without a term holds the singular values."""
        rows = [(t, float(w), v.tolist()) for t, w, v in zip(self.terms, self.idf, self.vectors)]
        return spark.createDataFrame([*rows, (None, None, self.values.tolist())], "term string, idf double, vector array<double>")

    @staticmethod
    def of_table(table: DataFrame, max_terms: int = Settings.max_terms) -> LatentModel:
        if table.count() > max_terms + 1:
            raise ValueError("more terms than the bound of a model")
        rows = sorted((r for r in table.collect() if r.term is not None), key=lambda r: r.term)
        values = [r.vector for r in table.where("term IS NULL").collect()]
        return LatentModel(tuple(r.term for r in rows), np.array([r.idf for r in rows]), np.array([r.vector for r in rows]), np.array(values[0] if values else []))


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> LatentModel:
    """The right singular vectors of largest value of all documents' weights. A corpus of fewer terms or documents than dimensions
    has as many as its rank allows; one without any has none. Rows that repeat an id are one document."""
    docs = docs.where(F.col(id_col).isNotNull())
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("d")).first()
    tokens = None
    if ids.n == ids.d:
        df = materialize(document_frequency(docs, id_col, text_col), "latent")
        terms = _most_frequent(df.where("term IS NOT NULL"), sum(r.df for r in df.where("term IS NULL").collect()), settings)
    else:  # rows that repeat an id meet by a shuffle of their counted tokens
        tokens = materialize(bm25.postings(docs, id_col, text_col), "latent")
        terms = vocabulary(tokens, tokens.agg(F.count_distinct("doc_id")).first()[0], settings)
    if not terms:
        return LatentModel((), np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    rows = materialize(text_rows(docs, terms, id_col, text_col) if tokens is None else document_rows(tokens, terms), "latent")
    width = min(settings.dimensions + settings.extra, len(terms))
    columns = np.linalg.qr(np.random.RandomState(settings.seed).standard_normal((len(terms), width)))[0]
    for _ in range(settings.rounds):
        columns = np.linalg.qr(gram_product(rows, columns))[0]
    _, values, right = np.linalg.svd(triangle(rows, columns), full_matrices=False)
    kept = min(settings.dimensions, int((values > 1e-9 * values.max(initial=0)).sum()))
    vectors = columns @ right[:kept].T
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)] < 0, -1, 1)  # a defined sign
    return LatentModel(tuple(t for t, _ in terms), np.array([w for _, w in terms]), vectors, values[:kept])


class LatentEmbedder:
    """Documents and queries by one model, scaled to unit length; a text without a known term is the zero vector."""

    def __init__(self, model: LatentModel):
        self._model, self._number = model, {t: i for i, t in enumerate(model.terms)}

    def initialize(self) -> None:
        """Nothing is loaded: the model came with the embedder."""

    def dispose(self) -> None:
        """Nothing is held outside Python."""

    def dimension(self) -> int:
        return self._model.vectors.shape[1]

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.vector(split_tokens(t)).tolist() for t in texts]

    def vector(self, tokens: Sequence[str]) -> np.ndarray:
        counts = Counter(self._number[t] for t in tokens if t in self._number)
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        weights = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self._model.idf[at]
        out = weights @ self._model.vectors[at] if len(at) else np.zeros(self.dimension())
        size = np.linalg.norm(out)
        return out / size if size > 1e-12 else out * 0


def split_tokens(text: str | None) -> list[str]:
    """As functions.text splits documents' tokens."""
    return [t for t in _BREAK.split((text or "").lower()) if t and t not in STOP_WORDS]


def embed(docs: DataFrame, model: LatentModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, embedding) of each row: LatentEmbedder's vectors, of a slice of texts at once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names, width = pa.array(model.terms, pa.string()), model.vectors.shape[1]
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                out = np.zeros((part.num_rows, width))
                row, term, n = _known(part.column("text"), names)
                for first, used, dense in _blocks(row, term, (1 + np.log(n)) * model.idf[term], part.num_rows):
                    out[first : first + len(dense)] = dense @ model.vectors[used]
                size = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.where(size > 1e-12, out / np.maximum(size, 1e-12), 0.0)
                offsets = pa.array(np.arange(part.num_rows + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["doc_id", "embedding"])

    texts = _lower(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, embedding array<double>")
