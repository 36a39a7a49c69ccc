from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from lodeseek.llm import lexical_search as L
from tests.llm.conftest import CLASHING, frame, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, items, k):
    """Every document against every item, by the formula."""
    words = {i: [w.translate(AZ) for w in TERM.findall(t or "")] for i, t in texts}
    docs = {i: Counter(w) for i, w in words.items()}
    n_docs, total = sum(bool(w) for w in words.values()), sum(map(len, words.values()))
    df = Counter(t for c in docs.values() for t in c)
    out = []
    for item, text in items:
        asked = Counter(w.translate(AZ) for w in TERM.findall(text or ""))
        found = []
        for i, c in docs.items():
            score = 0
            for t, times in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * len(words[i]) * n_docs) // total
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def asked(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS n", "1 AS id")


def answer(df):
    return sorted((r.item_id, r["rank"], r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("segment_docs, block, max_items", [(1 << 14, 128, 1000), (40, 4, 1000), (7, 1, 9)])
def test_as_by_brute_force(spark, rng, oddities, segment_docs, block, max_items):
    texts = [prose(rng, rng.choice([3, 20, 200])) for _ in range(260)] + ["Same Words here"] * 60 + oddities
    rng.shuffle(texts)
    items = [(i, prose(rng, rng.randint(1, 12))) for i in range(25)] + [(50, "same same words"), (51, ""), (52, None), (53, "nowhere"), (54, "日本語 İK ünïcödé"), (55, "W1 v2 word")]
    got = L.search(frame(spark, texts, CLASHING + " n terms"), asked(spark, items), 10, max_items, segment_docs, block)
    assert answer(got) == brute(list(enumerate(texts)), items, 10)


def test_ids_that_repeat_or_lack(spark):
    docs = frame(spark, ["red blue", "red", "green leaf", "a tree"])
    docs = docs.unionByName(docs).unionByName(frame(spark, ["red red"]).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars"))
    got = answer(L.search(docs, asked(spark, [(1, "red"), (1, "tree"), (None, "red")]), 20))
    assert [r[2] for r in got] == [0, 0, 1, 1] or [r[2] for r in got] == [1, 1, 0, 0]
    assert [r[1] for r in got] == [1, 2, 3, 4] and got[0][3] == got[1][3]


def test_empty_tables(spark):
    docs = frame(spark, ["a b"])
    assert answer(L.search(docs.limit(0), asked(spark, [(1, "a")]))) == []
    assert answer(L.search(docs, asked(spark, [(1, "a")]).limit(0))) == []
    assert answer(L.search(frame(spark, [None, ""]), asked(spark, [(1, "a")]))) == []


def test_blocks_round_trip():
    rng = np.random.RandomState(3)
    for top in (1, 200, 70_000, 3_000_000):
        places, tf = np.unique(rng.randint(0, top, 100)), rng.randint(1, top + 1, 100)
        a, b = L.unpack_block(L.pack_block(places, tf[: len(places)]), len(places))
        assert (a == places).all() and (b == tf[: len(places)]).all()
    assert len(L.pack_block(np.arange(128), np.ones(128, int))) == 1 + 2 * 128


def test_blocks_below_the_demand_stay_compressed():
    """Twenty documents that hold all rare terms: the blocks of the frequent one are opened only around them."""
    n = 4000
    rare = {i: [0, 1, 2] for i in range(0, 400, 20)}
    terms = [np.array([9, *rare.get(i, [])]) for i in range(n)]
    times = [np.ones(len(t), dtype=np.int64) for t in terms]
    segment = L.Segment(L.build_segment(list(range(n)), np.full(n, 100), terms, times, 128))
    query = [(9, 100), (0, 5000), (1, 5000), (2, 5000)]
    best = L.search_segment(segment, query, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 20)
    assert sorted(best[1]) == sorted(rare)
    assert len(segment.postings) > 30 and segment.decompressed <= 12


def test_a_full_heap_skips_a_later_segment():
    low = [np.array([0])] * 300
    segment = L.Segment(L.build_segment(list(range(300)), np.full(300, 100), low, [np.ones(1, np.int64)] * 300))
    best = (np.full(20, 10**12), np.arange(20))
    assert L.search_segment(segment, [(0, 10)], best, 20)[0].tolist() == best[0].tolist() and segment.decompressed == 0
