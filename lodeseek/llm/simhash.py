"""Near-duplicate detection with SimHash fingerprints and Golay-code fuzzy keys.

Equal fingerprints are merged before any key is made, so a hot group of copies is one row. Pairs that share a key
(see fuzzy_pairs) are verified by their exact Hamming distance. Where links must also pass a comparison of shingle
sets, see near_sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.arrowtools import LOWER_AZ, map_batches, signed, texts_of
from lodeseek.llm.components import connected_components
from lodeseek.llm.fuzzy_pairs import exact, first_pass, partitions_for, prefix_bits_for, second_pass
from lodeseek.session import materialize

SEED = 42
#: Differing bits up to which every pair shares a key.
GUARANTEED_BITS = 5


def shingles_of(text: bytes, words: int) -> list[bytes]:
    """Lower-cased (A-Z) runs of non-space joined by spaces; fewer words: the whole sequence; none: no shingle."""
    return [x for block in shingle_blocks(text, words) for x in block]


def shingle_blocks(text: bytes, words: int, block: int = 65_536) -> Iterator[list[bytes]]:
    """The shingles in order, so many at a time: those of a very long text never stand in memory together."""
    parts = text.translate(LOWER_AZ).split()
    if parts and len(parts) < words:
        yield [b" ".join(parts)]
    for i in range(0, len(parts) - words + 1, block):
        some = parts[i : i + block + words - 1]
        yield list(map(b" ".join, zip(*(some[j:] for j in range(words)))))


def fingerprint_of(text: bytes, words: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64 (seed 42); no words: 0."""
    return int(fingerprints_of(text, words, 1)[0])


def fingerprints_of(text: bytes, words: int, rounds: int) -> np.ndarray:
    """SimHashes of as many independent hashes: XXH64, then what a bijective mix makes of the one before."""
    return fingerprints_of_hashes(hashes_of(text, words), rounds)


def hashes_of(text: bytes, words: int) -> np.ndarray:
    found = [np.fromiter(map(xxhash.xxh64_intdigest, b, repeat(SEED)), dtype=np.uint64, count=len(b)) for b in shingle_blocks(text, words)]
    return np.concatenate(found) if len(found) > 1 else (found[0] if found else np.zeros(0, dtype=np.uint64))


def fingerprints_of_hashes(hashes: np.ndarray, rounds: int) -> np.ndarray:
    return simhashes([hashes], rounds)[0]


def simhashes(lists: list[np.ndarray], rounds: int) -> np.ndarray:
    """[lists, rounds]: the SimHashes of each list of hashes, 0 for an empty one.

    Bits are counted for all lists at once, eight bits at a time with one to a byte, in runs that a byte can count."""
    out = np.zeros((len(lists), rounds), dtype=np.uint64)
    size = np.array([len(h) for h in lists], dtype=np.int64)
    if not size.sum():
        return out
    full = np.flatnonzero(size)
    runs = -(-size[full] // 255)
    first = np.cumsum(runs) - runs  # of each list, among the runs
    within = np.arange(runs.sum()) - np.repeat(first, runs)
    start = np.repeat(np.cumsum(size[full]) - size[full], runs) + 255 * within
    h = np.concatenate([lists[i] for i in full])
    for turn in range(rounds):
        if turn:
            h = mixed(h)
        total = np.empty((len(full), 8, 8), dtype=np.int64)
        for b in range(8):
            lanes = np.add.reduceat((h >> np.uint64(b)) & np.uint64(0x0101010101010101), start)
            total[:, :, b] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = 2 * total.reshape(-1, 64) > size[full][:, None]
        out[full, turn] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): a row for each input row; null and empty texts have fingerprint 0."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "fp": signed(simhashes([hashes_of(t, words) for t in texts_of(batch, "_t")], 1)[:, 0].copy())}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"))
    return map_batches(rows, run, "id long, fp long")


def classes(nodes: DataFrame, bits: int = 3, **settings) -> DataFrame:
    """nodes (node long, fp long, distinct) -> (node, component): what pairs within so many bits connect, of nodes linked to another."""
    if bits > GUARANTEED_BITS:
        raise ValueError(f"keys find all pairs up to {GUARANTEED_BITS} bits only")
    s = exact(bits, **settings)
    nodes = nodes.select("node", F.lit(0).alias("n"), "fp")
    total = nodes.count()
    prefix_bits = prefix_bits_for(total, s)
    found = materialize(first_pass(nodes, s, prefix_bits, partitions_for(nodes, total, s, 1)), "simhash", True)
    groups = materialize(connected_components(found), "simhash")
    deep = found.where("u = v").select(F.col("u").alias("node"))
    if deep.isEmpty():
        return groups
    label = nodes.join(deep, "node", "left_semi").join(groups, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    label = materialize(label, "simhash", True)
    more = materialize(second_pass(label, s, prefix_bits, partitions_for(label, label.count(), s, 1)), "simhash", True)
    return connected_components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component long) for each row of docs; component is the smallest id that links reach.

    Null and empty texts have fingerprint 0 and link like any other, rows of one fingerprint always. Rows that repeat an
    id each return a row. A null id returns a null component unless its fingerprint has another id. Texts of any length are
    hashed whole. An empty table returns no rows. Other columns of docs, whatever their names, are not read."""
    fps = materialize(fingerprints(docs, words, id_col, text_col), "simhash")
    unique = materialize(fps.groupBy("fp").agg(F.min("id").alias("node")), "simhash", True)
    groups = classes(unique.where("node IS NOT NULL"), max_bits)
    label = unique.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return fps.join(materialize(label, "simhash", True), "fp").select("id", "fp", "component")
