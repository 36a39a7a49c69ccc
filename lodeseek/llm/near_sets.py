"""Classes of near-equal shingle sets: Golay keys propose pairs, a wide fingerprint screens them, the sets decide.

Each distinct set is a node with several independent 64-bit SimHashes of its shingles (see fuzzy_pairs). The first few make keys;
all together screen, since the distribution of their differing bits at the least similarity is known; what passes is
compared shingle by shingle. The first pass's forest is verified, and verified pairs joined to classes. Where every
pair of the forest passed, all candidates are in one class and nothing is left to do. Where one failed, the nodes of both its
classes are not settled: they get more SimHashes, so that the screen lets little through that the sets then refuse, and all
their screened pairs of different classes are listed and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.arrowtools import map_batches, signed, texts_of
from lodeseek.llm.components import connected_components
from lodeseek.llm.fuzzy_pairs import Settings, fingerprint_columns, first_pass, partitions_for, prefix_bits_for, second_pass
from lodeseek.llm.simhash import hashes_of, simhashes
from lodeseek.session import materialize


def set_sketches(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, same binary, n int, fp long, fp1, ...): a 128-bit hash of the text's distinct shingles, their number and their SimHashes."""

    names = fingerprint_columns(s.width)

    def run(batch: pa.RecordBatch) -> dict:
        sets = [np.unique(hashes_of(t, s.words)) for t in texts_of(batch, "_t")]
        fps = signed(simhashes(sets, s.width))
        same = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
        return {"id": batch.column("id"), "same": same, "n": [len(h) for h in sets]} | {n: np.ascontiguousarray(fps[:, i]) for i, n in enumerate(names)}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"))
    return map_batches(rows, run, "id long, same binary, n int, " + ", ".join(f"{n} long" for n in names))


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    if not len(x) and not len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def sets_of(ids: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str, width: int = 0) -> DataFrame:
    """(id, set binary, SimHashes if asked for) of the documents with these ids (id), written out. Only their texts are hashed; they
    are found by a join that Spark broadcasts only if its table is small. Of texts that share an id one counts."""
    names = fingerprint_columns(width) if width else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t")).join(ids, "id", "left_semi")

    def sets(batch: pa.RecordBatch) -> dict:
        hashes = [np.unique(hashes_of(t, s.words)) for t in texts_of(batch, "_t")]
        out = {"id": batch.column("id"), "set": [np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in hashes]}
        if width:
            fps = signed(simhashes(hashes, width))
            out |= {n: np.ascontiguousarray(fps[:, i]) for i, n in enumerate(names)}
        return out

    found = map_batches(rows, sets, ", ".join(["id long", "set binary", *(f"{n} long" for n in names)]))
    once = found.groupBy("id").agg(F.max_by(F.struct("set", *names), "set").alias("_s")).select("id", "_s.*")
    return materialize(once, "nearsets", True)


def verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Of pairs (u, v) of ids those whose shingle sets (id, set) are at least that similar, by exact set comparison."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("su")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("set").alias("sv")), "v"
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            su, sv = batch.column("su").to_pylist(), batch.column("sv").to_pylist()
            near = pa.array([jaccard(a, b) >= s.min_jaccard for a, b in zip(su, sv)], pa.bool_())
            yield batch.select(["u", "v"]).filter(near)

    return both.select("u", "v", "su", "sv").mapInArrow(keep, "u long, v long")


def classes(nodes: DataFrame, docs: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """nodes (node long, n int, fp long, ...) -> (node, component): classes that pairs at min_jaccard or more connect,
    of nodes linked to another one. docs has the text of every node under its id."""
    total = nodes.count()
    prefix_bits = prefix_bits_for(total, s)
    found = materialize(first_pass(nodes, s, prefix_bits, partitions_for(nodes, total, s, s.width)), "nearsets", True)
    ends = found.where("u <> v")
    linked = materialize(ends.select(F.col("u").alias("id")).union(ends.select("v")).distinct(), "nearsets", True)
    passed = materialize(verified(ends, sets_of(linked, docs, s, id_col, text_col), s), "nearsets", True)
    groups = materialize(connected_components(passed), "nearsets")
    label = nodes.join(groups, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    label = materialize(label, "nearsets", True)
    side = lambda end: label.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    failed = ends.join(side("u"), "u").join(side("v"), "v").where("lu <> lv")
    torn = materialize(failed.select(F.explode(F.array("lu", "lv")).alias("label")).distinct(), "nearsets", True)
    deep = found.where("u = v").select(F.col("u").alias("node"))
    open_nodes = label.select("node", "n", "label").join(torn, "label", "left_semi")
    others = label.select("node", "n", "label").join(torn, "label", "left_anti").join(deep, "node", "left_semi")
    open_nodes = materialize(open_nodes.unionByName(others), "nearsets", True)
    n_open = open_nodes.count()
    if n_open == 0:
        return groups
    sets = sets_of(open_nodes.select(F.col("node").alias("id")), docs, s, id_col, text_col, s.wide)
    wide = open_nodes.join(sets.drop("set").withColumnRenamed("id", "node"), "node")
    more = materialize(second_pass(wide, s, prefix_bits, partitions_for(wide, n_open, s, s.wide)).join(ends, ["u", "v"], "left_anti"), "nearsets", True)
    more = materialize(verified(more, sets, s), "nearsets", True)
    return connected_components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))


def near_copies(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component long) for each row of docs: the smallest id that links reach, a link being two shingle sets at
    min_jaccard or more.

    Rows of the same set are one node, so a hot group of copies is one row of what follows. Null and empty texts have
    no shingle and are alike. Rows that repeat an id each return a row; if their texts differ, links of any of them are
    links of the id. A null id returns a null component unless its set has another id. An empty table returns no rows."""
    s = settings
    sketches = materialize(set_sketches(docs, s, id_col, text_col), "nearsets")
    unique = sketches.groupBy("same").agg(F.min("id").alias("node"), F.max("n").alias("n"), *(F.max(c).alias(c) for c in fingerprint_columns(s.width)))
    unique = materialize(unique, "nearsets", True)
    groups = classes(unique.where("node IS NOT NULL").drop("same"), docs, s, id_col, text_col)
    label = unique.select("same", "node").join(groups, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    return sketches.select("id", "same").join(label, "same").select("id", "component")


def keep_one_of_each(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group the row of the smallest id stays, with all its columns.

    Rows that repeat an id are one document, of which one row stays: that of the text that sorts first (null before all), and of
    equal texts by a digest of all columns. Rows with a null id cannot be named, so they
    stay. Texts are not shuffled unless the table of removed ids is too large for Spark to broadcast."""
    found = materialize(near_copies(docs, settings, id_col, text_col), "nearsets", True)
    removed = materialize(found.where("id <> component").select(F.col("id").alias(id_col)).distinct(), "nearsets")
    repeated = materialize(found.where("id IS NOT NULL").groupBy(F.col("id").alias(id_col)).count().where("count > 1").select(id_col), "nearsets")
    kept = docs.join(removed, id_col, "left_anti")
    if not repeated.isEmpty():
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        first = F.struct(F.col(text_col), F.sha2(F.to_json(whole), 256))  # the same row however rows are dealt; aggregated before the shuffle
        one = kept.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min_by(whole, first).alias("_row")).select("_row.*")
        kept = kept.join(repeated, id_col, "left_anti").select(*docs.columns).unionByName(one)
    return kept.select(*docs.columns)
