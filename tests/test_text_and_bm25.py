from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.operators import bm25


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Cargo, Harbour! (a crane)", ["cargo", "harbour", "crane"]),
        ("user_name@mail.com v2+3=5", ["user", "name", "mail", "com", "v2+3=5"]),
        ("", []),
        (None, []),
        ("the and of", []),
        ("a b　c", ["b", "c"]),
        ("données été", ["données", "été"]),
    ],
)
def test_tokens(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t")).alias("x")).first()
    assert row.x == expected


def test_positions_count_after_stop_words(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog cat")], "doc_id long, text string")
    got = {r.term: (r.frequency, r.positions) for r in bm25.postings(docs, with_positions=True).collect()}
    assert got == {"cat": (2, [0, 2]), "dog": (1, [1])}


def brute_bm25(docs, query, k1=1.5, b=0.75):
    import re

    split = lambda t: [x for x in re.split(r"[\s\-_@.,:;!?(){}\[\]<>/\\|\"'`~]+", t.lower()) if x and x not in T.STOP_WORDS]
    toks = {i: split(t) for i, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    out = {}
    for q in split(query):
        df = sum(q in t for t in toks.values())
        for i, t in toks.items():
            if tf := t.count(q):
                idf = math.log((len(toks) - df + 0.5) / (df + 0.5) + 1)
                out[i] = out.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
    return out


def test_search_matches_brute_force_with_repeats_and_empty_documents(spark):
    rows = [(1, "tall grey crane"), (2, "idle tug sleeps"), (3, "tall tall tug"), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_bm25([(i, t or "") for i, t in rows], "tall tug tall")
    for found in (bm25.search_documents(docs, "tall tug tall", 10), bm25.search(bm25.postings(docs), bm25.doc_stats(docs), "tall tug tall", 10)):
        got = {r.doc_id: r.score for r in found.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_search_without_tokens_or_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bm25.search_documents(docs, "anything").count() == 0
    assert bm25.search_documents(docs, "the of").count() == 0
    assert bm25.search(bm25.postings(docs), bm25.doc_stats(docs), "x").count() == 0


def test_reindex_replaces_a_document(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "gamma")], "doc_id long, text string")
    index, stats = bm25.replace_documents(bm25.postings(docs), bm25.doc_stats(docs), new)
    assert {(r.term, r.doc_id) for r in index.collect()} == {("alpha", 2), ("gamma", 1)}
    assert {(r.doc_id, r.length) for r in stats.collect()} == {(1, 1), (2, 1)}


def test_edit_similarity_and_normalisation(spark):
    row = spark.createDataFrame([("kitten", "sitting", "  a = 1 \n\n// no\n# no\n  b")], "a string, b string, c string").select(
        T.edit_similarity(F.col("a"), F.col("b")).alias("s"), T.edit_similarity(F.lit(""), F.lit("")).alias("e"), T.normalize_code(F.col("c")).alias("n")
    ).first()
    assert abs(row.s - (1 - 3 / 7)) < 1e-12 and row.e == 1.0 and row.n == "a = 1\nb"


def test_occurrences_match_brute_force(spark):
    """Overlapping ones, at both ends, beside characters outside the basic plane; names that regular expressions would read."""
    import random

    rng = random.Random(3)
    lines = ["aaaa", "", "xaXa", "\\E.\\E", "é😀a😀aé"] + ["".join(rng.choices("ab.😀é\\E", k=rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    for name in ("a", "aa", "aba", ".", "😀", "😀a", "\\E", "b.", "E\\"):
        got = {r.i: r.x for r in df.select("i", T.occurrences(F.col("t"), name).alias("x")).collect()}
        for i, t in enumerate(lines):
            assert got[i] == [k for k in range(len(t)) if t.startswith(name, k)], (name, t)
    assert spark.range(1).select(T.occurrences(F.lit("a"), "").alias("y")).first().y == []


@pytest.mark.parametrize("span, path", [("src/a.ts", "src/a.ts"), (" ./b.py ", "./b.py"), ("/abs/c.go", "/abs/c.go"), ("word", None), ("a b.c", None)])
def test_file_paths(spark, span, path):
    assert spark.range(1).select(T.file_path_in(F.lit(span)).alias("p")).first().p == path
