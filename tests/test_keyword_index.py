"""The stored keyword index against a search of the texts themselves, before and after changes, and what its plans read."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import bm25
from lodeseek.operators.keyword_index import KeywordIndex
from lodeseek.session import scratch_root
from lodeseek.sources.store import Store

WORDS = [f"w{i}" for i in range(400)]


def texts(n: int, seed: int, first: int = 0) -> list[tuple[int, str | None]]:
    """Words of falling frequency, a few long documents, empty and null ones."""
    r = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        size = r.choice([0, 3, 20, 60, 60, 60, 300])
        rows.append((i, None if i % 97 == 5 else " ".join(WORDS[min(int(r.paretovariate(0.6)) - 1, 399)] for _ in range(size))))
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


@pytest.fixture
def index(spark):
    return KeywordIndex(Store(spark, f"{scratch_root(spark)}/keyword-{uuid.uuid4().hex}"), segment_docs=16, first_segments=4)


def same(index, docs, query, k=10, params=bm25.Params()):
    rounded = lambda df: [(r.doc_id, round(r.score, 6)) for r in df.collect()]
    got, want = rounded(index.search(query, k, params)), rounded(bm25.search_documents(docs, query, k, params))
    assert got == want, query
    return got


def test_searches_equal_a_scan_of_the_texts(spark, index):
    docs = docs_of(spark, texts(800, 1)).cache()
    index.create(docs)
    for query in ("w7 w30", "w200 w0 w0 w300", "W9! w399"):
        same(index, docs, query)
    assert len(same(index, docs, "w250 w251", 800)) < 800
    same(index, docs, "w3 w40", 10, bm25.Params(1.2, 0.3))
    assert index.search("the of", 5).count() == 0 and index.search("nowhere", 5).count() == 0 and index.search("w1", 0).count() == 0


def test_a_search_opens_few_segments_and_reads_its_words_folders(spark, index):
    filler = texts(3000, 2)
    rare = [(10_000 + i, " ".join(["w0"] * (5 + i) + ["w1"])) for i in range(12)]
    docs = docs_of(spark, filler + rare)
    index.create(docs)
    same(index, docs, "w0 w1", 3)
    segments = index.blocks_of_terms(["w0", "w1"]).select("segment").distinct().count()
    assert index.opened["opened"] * 4 < segments
    plan = index.blocks_of_terms(["w7"])._jdf.queryExecution().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,w7)" in plan
    bounds = index.blocks_of_terms(["w7"]).groupBy("segment").agg(F.max("max_frequency"))
    assert "entries" not in bounds._jdf.queryExecution().executedPlan().toString()  # bounds are read without postings


def test_changes_keep_the_answer_of_a_scan(spark, index, monkeypatch):
    monkeypatch.setattr("lodeseek.sources.store.MAX_PARTS", 3)  # so that changes are merged
    now = dict(texts(600, 3))
    index.create(docs_of(spark, now.items()))
    r = random.Random(4)
    for step in range(4):
        changed = dict(texts(5, 100 + step, r.randrange(600)) + [(1000 + step, f"w5 w{step} fresh")])
        dead = r.sample(sorted(now), 3) + [-1]
        index.replace(docs_of(spark, changed.items()), spark.createDataFrame([(d,) for d in dead if d not in changed], "doc_id long"))
        now = {d: t for d, t in (now | changed).items() if d in changed or d not in dead}
        if step in (0, 3):
            docs = docs_of(spark, now.items())
            for query in ("fresh", "w0 w3 w90"):
                same(index, docs, query)
    state = index._table("state").first()
    assert state.documents == len(now) and state.epoch > 0
    index.lay_out()
    same(index, docs_of(spark, now.items()), "w5 w1")
    assert index._table("gone").count() == 0


def test_many_dead_documents_lead_to_a_new_layout(spark, index):
    now = dict(texts(200, 5))
    index.create(docs_of(spark, now.items()))
    index.delete(spark.createDataFrame([(d,) for d in range(120)], "doc_id long"))
    assert index._table("gone").count() == 0 and index._table("state").first().epoch == 0
    same(index, docs_of(spark, [(d, t) for d, t in now.items() if d >= 120]), "w0 w2")


def test_a_change_that_fails_is_not_seen(spark, index):
    docs = docs_of(spark, texts(100, 6))
    index.create(docs)
    with pytest.raises(RuntimeError), index.store.transaction():
        index.replace(docs_of(spark, [(5, "fresh")]))
        raise RuntimeError
    assert index.search("fresh").count() == 0
    same(index, docs, "w0")


def test_empty_tables_repeated_ids_and_other_columns(spark, index):
    index.create(docs_of(spark, []))
    assert index.search("w0").count() == 0
    index.replace(docs_of(spark, [(1, "w0 w1"), (2, None), (3, "")]))
    assert [r.doc_id for r in index.search("w0").collect()] == [1]
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            index.create(docs_of(spark, rows))
    clashing = spark.createDataFrame([("x", "w0 w0", 1, 2), ("y", "w0", 3, 4)], "id string, body string, segment long, entries long")
    other = KeywordIndex(index.store, "other")
    other.create(clashing, "id", "body")
    assert [r.doc_id for r in other.search("w0").collect()] == ["x", "y"]


def test_blocks_of_texts_hold_the_postings_and_no_posting_is_shuffled(spark, index, monkeypatch):
    """Every posting was shuffled twice and gathered row by row."""
    docs = docs_of(spark, texts(500, 7) + [(900, "W1\x0bw2 w3　The w1"), (901, " ".join(f"x{i}" for i in range(3000)))])
    index.create(docs)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = index._checked(docs, "doc_id", "text")
    lengths = {r.doc_id: r.length for r in rows.select("doc_id", "length").collect()}
    assert lengths == {r.doc_id: r.length for r in bm25.doc_stats(docs).collect()}
    state = index._state()
    made = index._blocks_of_texts(rows, state.segments, state.buckets, state.documents, state.tokens, 0)
    assert "Generate" not in plan(made) and "collect_list" not in plan(made)
    want = {(r.term, r.doc_id): (r.frequency, lengths[r.doc_id]) for r in bm25.postings(docs).collect()}
    for size in (8 << 20, 3000):  # whole tables at once; slices that end in segments
        monkeypatch.setattr("lodeseek.operators.keyword_index.SLICE_BYTES", size)
        blocks = index._blocks_of_texts(rows, state.segments, state.buckets, state.documents, state.tokens, 0).collect()
        found = [(b.term, e.doc_id, e.frequency, e.length) for b in blocks for e in b.entries]
        assert len(found) == len(want) and {(t, d): (f, n) for t, d, f, n in found} == want
        segments = {r.doc_id: r.segment for r in index._table("docs").collect()}
        for b in blocks:
            assert (b.n, b.max_frequency, b.min_length) == (len(b.entries), max(e.frequency for e in b.entries), min(e.length for e in b.entries))
            assert {segments[e.doc_id] for e in b.entries} == {b.segment}
        index.create(docs)
        same(index, docs, "w0 w3 w90")


def test_a_new_layout_is_made_of_stored_terms_and_no_posting_is_shuffled(spark, index, monkeypatch):
    """Living postings were written as rows, shuffled one by one and gathered again, after blocks that the new layout then replaced."""
    now = dict(texts(400, 8))
    docs = docs_of(spark, now.items())
    index.create(docs)
    terms = {(r.doc_id, t): n for r in index._table("terms").collect() for t, n in zip(r.terms.split(), r.frequencies, strict=True)}
    assert terms == {(r.doc_id, r.term): r.frequency for r in bm25.postings(docs).collect()}
    written, folder = [], index.store._write_folder
    monkeypatch.setattr(index.store, "_write_folder", lambda name, df, *a, **k: written.append((name, df)) or folder(name, df, *a, **k))
    changed = {d: f"{now[d] or ''} fresh w7" for d in range(0, 400, 9)}
    index.replace(docs_of(spark, changed.items()), spark.range(1, 400, 6).selectExpr("id AS doc_id"))
    now = {d: changed.get(d, t) for d, t in now.items() if d in changed or d % 6 != 1}
    assert index._state().epoch == 0 and index._state().documents == len(now)
    blocks = [df._jdf.queryExecution().optimizedPlan().toString() for name, df in written if name == "keyword_blocks"]
    assert len(blocks) == 1 and "Generate" not in blocks[0] and "collect_list" not in blocks[0]
    stored = index._table("terms").collect()
    assert len(stored) == len(now) and {r.doc_id for r in stored} == set(now)
    for query in ("fresh w7", "w0 w3 w90"):
        same(index, docs_of(spark, now.items()), query)


@pytest.mark.parametrize("n_gone", [3, 60])
def test_an_index_stored_before_terms_were_is_changed_and_laid_out(spark, index, n_gone):
    """Both with blocks that stay and with a new layout; documents without tokens still count."""
    now = dict(texts(150, 9))
    index.create(docs_of(spark, now.items()))
    index.replace(docs_of(spark, [(7, "w1 w1 fresh")]))
    index.store.drop("keyword_terms")
    index.replace(docs_of(spark, [(500, "fresh w2"), (501, None)]), spark.range(10, 10 + n_gone).selectExpr("id AS doc_id"))
    now = {d: t for d, t in (now | {7: "w1 w1 fresh", 500: "fresh w2", 501: None}).items() if not 10 <= d < 10 + n_gone}
    assert (index._state().epoch == 0) == (n_gone == 60) and index._state().documents == len(now)
    for query in ("fresh w1", "w0 w3 w90"):
        same(index, docs_of(spark, now.items()), query)
    index.lay_out()
    same(index, docs_of(spark, now.items()), "w0 w2")
