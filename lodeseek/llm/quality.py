"""Quality scores by nearest-neighbour voting in a latent semantic space.

A document is a bag of hashed terms: its words and, counted apart, the shapes of its tokens (letters,
capitals, digits and each kind of punctuation, repeats folded) with a few graded statistics (distinct
share of words and lines, length). Both halves are weighted by log counts and inverse document frequency and
projected on the leading singular vectors of a labelled sample.

The sample (at most ``max_rows`` labelled rows) is all that is learnt from; its unit vectors are broadcast:
max_rows x (2 x rank) floats, a bound that no corpus moves. Every document's cosines with all of them are
exact products of blocks, and the ``neighbours`` nearest vote with weights that grow with similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.arrowtools import LOWER_ALNUM, map_batches, texts_of
from lodeseek.llm.labelled import held_out, labelled_texts


@dataclass(frozen=True)
class Settings:
    max_rows: int = 5_000
    hash_bits: int = 11
    rank: int = 40
    neighbours: int = 41
    sharpness: float = 4.0
    block: int = 512
    seed: int = 5


SHAPE = bytes(
    ord("a") if chr(b).islower() and b < 128 or b >= 128 else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b for b in range(256)
)
REPEAT = re.compile(rb"(.)\1+", re.DOTALL)


def grade(share: float) -> int:
    return int(np.ceil(share * 10 - 1e-9))


def bag_of(text: bytes, hash_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts): words in the lower half of 2**(hash_bits + 1) slots, shapes and statistics in the upper."""
    words = Counter(text.translate(LOWER_ALNUM).split())
    tokens = text.translate(SHAPE).split()
    shapes: Counter = Counter()
    for shape, n in Counter(tokens).items():
        shapes[REPEAT.sub(rb"\1", shape)] += n
    lines = text.split(b"\n")
    total = sum(words.values())
    known = {
        b"\0distinct words %d" % grade(len(words) / total if total else 0): max(total, 1),
        b"\0distinct lines %d" % grade(len(set(lines)) / len(lines)): max(total, 1),
        b"\0length %d" % total.bit_length(): max(total, 1),
    }
    half = 1 << hash_bits
    names = [*words, *shapes, *known]
    h = np.fromiter(map(xxhash.xxh32_intdigest, names, repeat(29)), dtype=np.uint32, count=len(names)).astype(np.int64) & (half - 1)
    h[len(words) :] += half
    counts = np.fromiter([*words.values(), *shapes.values(), *known.values()], dtype=np.float64, count=len(names))
    slots, inverse = np.unique(h, return_inverse=True)
    return slots, np.bincount(inverse, weights=counts, minlength=len(slots))


@dataclass
class Model:
    weight: np.ndarray  # idf of each slot
    project: np.ndarray  # [slots, 2 x rank]
    vectors: np.ndarray  # [labelled rows, 2 x rank], unit length
    labels: np.ndarray
    prior: float
    settings: Settings

    def latent(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(bags), self.project.shape[1]), dtype=np.float32)
        half, width = len(self.weight) // 2, self.project.shape[1] // 2
        for i, (slots, counts) in enumerate(bags):
            values = np.log1p(counts) * self.weight[slots]
            cut = np.searchsorted(slots, half)
            for a, b, lo, hi in ((0, cut, 0, width), (cut, len(slots), width, 2 * width)):
                norm = np.sqrt((values[a:b] ** 2).sum())
                if norm > 0:
                    out[i, lo:hi] = (values[a:b] / norm) @ self.project[slots[a:b], lo:hi]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(vectors), self.prior)
        k = min(self.settings.neighbours, len(self.labels))
        out = np.empty(len(vectors))
        for i in range(0, len(vectors), self.settings.block):
            part = vectors[i : i + self.settings.block]
            # Blocks are filled up to one shape, so that a row's sums do not hang on the rows beside it.
            cosine = (np.pad(part, ((0, self.settings.block - len(part)), (0, 0))) @ self.vectors.T)[: len(part)]
            # Of rows that tie for the last place those listed first count.
            last = np.partition(cosine, -k, axis=1)[:, -k][:, None]
            above, tied = cosine > last, cosine == last
            room = k - above.sum(axis=1, keepdims=True)
            near = np.nonzero(above | (tied & (np.cumsum(tied, axis=1) <= room)))[1].reshape(len(cosine), k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** self.settings.sharpness
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[i : i + len(cosine)] = np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def leading_vectors(x: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """[columns, rank] right singular vectors by a randomised range finder with two power steps."""
    rng = np.random.RandomState(seed)
    y = x @ rng.randn(x.shape[1], rank + 8).astype(np.float32)
    for _ in range(2):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    out = np.zeros((x.shape[1], rank), dtype=np.float32)
    out[:, : min(rank, len(vt))] = vt[:rank].T
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Without labelled rows every text scores a half."""
    s = settings
    rows = labelled_texts(docs, labels, label, s.max_rows, id_col, text_col)

    def bags(batch: pa.RecordBatch) -> dict:
        found = [bag_of(t, s.hash_bits) for t in texts_of(batch, "_t")]
        return {"id": batch.column("id"), "label": batch.column("label"), "slots": [f[0].astype(np.int16).tobytes() for f in found], "counts": [f[1].astype(np.float32).tobytes() for f in found]}

    got = map_batches(rows, bags, "id long, label int, slots binary, counts binary").collect()
    got.sort(key=lambda r: (r.id, r.label, bytes(r.slots), bytes(r.counts)))
    slots, half, y = 2 << s.hash_bits, 1 << s.hash_bits, np.array([r.label for r in got], dtype=np.float64)
    x = np.zeros((len(got), slots), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.slots, dtype=np.int16)] = np.log1p(np.frombuffer(r.counts, dtype=np.float32))
    df = (x > 0).sum(axis=0)
    weight = np.log((1 + len(got)) / (1 + df)).astype(np.float32) + 0.1
    x *= weight
    project = np.zeros((slots, 2 * s.rank), dtype=np.float32)
    if len(got) > 1:
        for part, cols in ((slice(0, half), slice(0, s.rank)), (slice(half, slots), slice(s.rank, 2 * s.rank))):
            block = x[:, part]
            norm = np.linalg.norm(block, axis=1, keepdims=True)
            block /= np.where(norm > 0, norm, 1)
            project[part, cols] = leading_vectors(block, s.rank, s.seed)
    model = Model(weight, project, np.zeros((0, 2 * s.rank), np.float32), np.zeros(0), float(y.mean()) if len(y) else 0.5, s)
    raw = np.hstack([x[:, :half] @ project[:half, : s.rank], x[:, half:] @ project[half:, s.rank :]]) if len(got) else model.vectors
    norm = np.linalg.norm(raw, axis=1, keepdims=True)
    model.vectors, model.labels = (raw / np.where(norm > 0, norm, 1)).astype(np.float32), y
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) for each row: null and empty texts are the bag of no words; repeated rows a row each; an empty
    table returns none. Neighbours that tie for the last place count in the order of the labelled rows. Very long texts are
    counted whole. Other columns of docs, whatever their names, are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        m = shared.value
        latent = m.latent([bag_of(t, m.settings.hash_bits) for t in texts_of(batch, "_t")])
        return {"id": batch.column("id"), "held_out": batch.column("held_out"), "score": m.vote(latent)}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_t"))
    return map_batches(rows, run, "id long, held_out boolean, score double")
