"""Toxicity scores from a factorization machine over hashed terms.

A term is a word (ASCII letters and digits in lower case; punctuation parts words) hashed to
``2**hash_bits``; a document is the set of its terms. The machine's score adds a weight per term and, for
each pair of terms, the product of their latent vectors, so that a pair such as an insult with a group's
mention can weigh more than both words alone.

Learning uses at most ``max_rows`` labelled rows. Of their terms the ``features`` with the largest
chi-squared against the label are kept; counts are aggregated in Spark, and what reaches the driver is
that bounded list and a bitmap of it per labelled row. Scoring is one pass over whole texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.arrowtools import LOWER_ALNUM, limit_batches, map_batches, texts_of
from lodeseek.llm.labelled import held_out, labelled_texts
from lodeseek.session import materialize


@dataclass(frozen=True)
class Settings:
    max_rows: int = 16_000
    hash_bits: int = 18
    features: int = 512
    min_rows: int = 4
    factors: int = 6
    epochs: int = 250
    rate: float = 0.05
    l2_linear: float = 1e-6
    l2_factors: float = 5e-4
    seed: int = 7


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slot: np.ndarray  # of each hashed term: its feature, or -1

    def score(self, active: np.ndarray) -> float:
        """Probability for a document with these features, each once."""
        v = self.factors[active]
        total = v.sum(axis=0)
        z = self.bias + self.linear[active].sum() + 0.5 * float((total * total - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def terms_of(text: bytes, hash_bits: int) -> np.ndarray:
    """Distinct hashed terms of a whole text, sorted."""
    words = set(text.translate(LOWER_ALNUM).split())
    h = np.fromiter(map(xxhash.xxh32_intdigest, words, repeat(17)), dtype=np.uint32, count=len(words))
    return np.unique(h >> np.uint32(32 - hash_bits)).astype(np.int32)


def fit_machine(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, linear, factors) by full-batch Adam on the logistic loss; the rows are bounded, so is this."""
    rng = np.random.RandomState(s.seed)
    n, m = x.shape
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    params = [np.array([np.log(rate / (1 - rate))], dtype=np.float32), np.zeros(m, np.float32), (rng.randn(m, s.factors) * 0.02).astype(np.float32)]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    for t in range(1, s.epochs + 1 if n and m else 1):
        bias, w, v = params
        xv = x @ v
        z = bias[0] + x @ w + 0.5 * ((xv * xv).sum(1) - x @ (v * v).sum(1))
        g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n).astype(np.float32)
        xg = x.T @ g
        grads = [np.array([g.sum()], np.float32), xg + s.l2_linear * w, x.T @ (g[:, None] * xv) - v * xg[:, None] + s.l2_factors * v]
        for p, d, a, b in zip(params, grads, first, second):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            p -= s.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Without labelled rows the model has no features and scores every text alike (a half)."""
    s = settings
    rows = labelled_texts(docs, labels, label, s.max_rows, id_col, text_col)

    def features(batch: pa.RecordBatch) -> dict:
        return {"label": batch.column("label"), "terms": [terms_of(t, s.hash_bits) for t in texts_of(batch, "_t")]}

    sample = materialize(map_batches(rows, features, "label int, terms array<int>"), "toxicity")
    n, n1 = (int(v or 0) for v in sample.agg(F.count("*"), F.sum("label")).first())
    by_term = sample.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("n1"))
    lift = F.col("n1") * (n - n1) - (F.col("n") - F.col("n1")) * n1
    chi = (lift * lift / (F.col("n") * (n + 1 - F.col("n")))).alias("chi")
    best = [r.term for r in by_term.where(F.col("n") >= s.min_rows).select("term", chi).orderBy(F.desc("chi"), "term").limit(s.features).collect()]
    slot = np.full(1 << s.hash_bits, -1, dtype=np.int32)
    slot[best] = np.arange(len(best))

    def bitmap(batch: pa.RecordBatch) -> dict:
        out = []
        for terms in batch.column("terms").to_pylist():
            active = slot[np.array(terms, dtype=np.int64)]
            row = np.zeros(len(best), dtype=np.uint8)
            row[active[active >= 0]] = 1
            out.append(np.packbits(row).tobytes())
        return {"label": batch.column("label"), "bits": out}

    got = map_batches(sample, bitmap, "label int, bits binary").collect() if best else []
    got.sort(key=lambda r: (bytes(r.bits), r.label))
    y = np.array([r.label for r in got], dtype=np.float32)
    x = np.zeros((len(got), len(best)), dtype=np.float32)
    for i, r in enumerate(got):
        x[i] = np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), count=len(best))
    bias, linear, factors = fit_machine(x, y, s) if got else (0.0, np.zeros(len(best), np.float32), np.zeros((len(best), s.factors), np.float32))
    return Model(bias, linear, factors, slot)


def score(docs: DataFrame, model: Model, hash_bits: int = Settings.hash_bits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) for each row: null and empty texts get the score of no terms; repeated rows a row each, alike;
    an empty table returns none. A score hangs on the text's set of terms alone, so texts of equal terms tie. Very long
    texts are read whole. Other columns of docs, whatever their names, are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        m = shared.value
        out = np.zeros(batch.num_rows)
        for i, text in enumerate(texts_of(batch, "_t")):
            active = m.slot[terms_of(text, hash_bits)]
            out[i] = m.score(active[active >= 0])
        return {"id": batch.column("id"), "held_out": batch.column("held_out"), "score": out}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_t"))
    return map_batches(rows, run, "id long, held_out boolean, score double")


def score_column(docs: DataFrame, model: Model, hash_bits: int = Settings.hash_bits) -> Callable[[Column], Column]:
    """The score as a function of a text column, for filters that keep a row's other columns where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        m = shared.value
        active = (m.slot[terms_of(b"" if t is None else t, hash_bits)] for t in text.cast(pa.large_binary()).to_pylist())
        return pa.array([m.score(a[a >= 0]) for a in active], pa.float64())

    return toxicity
