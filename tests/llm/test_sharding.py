from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodeseek.llm import sharding as K
from tests.llm.conftest import CLASHING, frame, prose


def check(rows, texts, shards):
    assert sorted(r.id for r in rows) == list(range(len(texts)))
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        data = (texts[r.id] or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [size[i] for i in range(shards)]


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_sizes_are_near_equal_and_groups_whole(spark, rng, shards):
    texts = [prose(rng, rng.randint(5, 60)) for _ in range(900)] + ["a copied text"] * 25
    docs = frame(spark, texts, CLASHING)
    rows = K.shard(docs, K.Settings(shards=shards)).collect()
    sizes = check(rows, texts, shards)
    assert max(sizes) <= 1.06 * np.mean(sizes) and min(sizes) >= 0.94 * np.mean(sizes)
    assert len({r.shard for r in rows if texts[r.id] == "a copied text"}) == 1


def test_a_group_of_a_third_is_dealt_to_neighbouring_shards(spark, rng):
    texts = [prose(rng, 30) for _ in range(400)] + [prose(rng, 30)] * 200
    rows = K.shard(frame(spark, texts), K.Settings(shards=6)).collect()
    sizes = check(rows, texts, 6)
    assert max(sizes) <= 1.1 * np.mean(sizes) and len({r.shard for r in rows if r.id >= 400}) <= 4


def test_odd_rows(spark, oddities):
    docs = frame(spark, oddities, CLASHING)
    check(K.shard(docs).collect(), oddities, 40)
    plain = docs.select("doc_id", "text")
    check(K.shard(plain, K.Settings(shards=3)).collect(), oddities, 3)
    assert K.shard(docs.limit(0)).count() == 0
    twice = K.shard(docs.unionByName(docs), K.Settings(shards=2)).collect()
    assert len(twice) == 2 * len(oddities) and len({(r.shard, r.slot) for r in twice}) == len(twice)


def test_cuts_follow_the_widest_dimension(spark):
    """All texts alike in size; sources fall into two far halves, so the first cut parts them."""
    from pyspark.sql import functions as F

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.format_string("text %03d", "id").alias("text"), F.when(F.col("id") < 100, 1).otherwise(10**6).alias("n_chars"))
    got = K.shard(docs, K.Settings(shards=2, unit_share=0.01), metadata=("n_chars",)).collect()
    assert {r.shard for r in got if r.id < 100} == {0} and {r.shard for r in got if r.id >= 100} == {1}


@pytest.mark.parametrize("shards", [4, 7])
def test_the_tree_is_as_by_brute_force(spark, rng, shards):
    """Each node is cut along its widest dimension (relative to the whole), between two neighbours in the order of (value, text hash), at its
    share of the bytes to within one text and the tolerance; so, from the root down, every row's shard follows."""
    from pyspark.sql import functions as F

    texts = [prose(rng, rng.randint(3, 80)) for _ in range(500)] + [prose(rng, 10)] * 9
    docs = frame(spark, texts)
    s = K.Settings(shards=shards)
    names = ["source", "lang", "n_chars"]
    got = {r.id: r.shard for r in K.shard(docs, s, names).collect()}
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("g"), *(K.dimension(docs, n).alias(f"d{i}") for i, n in enumerate(names))).collect()
    units = {}
    for r in rows:
        u = units.setdefault(r.g, {"w": 0, "dims": [2**63] * 3, "ids": [], "g": r.g})
        u["w"] += len(texts[r.doc_id].encode()) + 16
        u["dims"] = [min(a, r[f"d{i}"]) for i, a in enumerate(u["dims"])]
        u["ids"].append(r.doc_id)
    units = list(units.values())
    span = lambda us, d: max(u["dims"][d] for u in us) - min(u["dims"][d] for u in us)
    overall = [max(1, span(units, d)) for d in range(3)]
    largest, total = max(u["w"] for u in units), sum(u["w"] for u in units)

    def descend(us, first, count):
        shard = lambda u: got[u["ids"][0]]
        assert {shard(u) for u in us} <= set(range(first, first + count))
        if count == 1:
            return
        widths = [span(us, d) / overall[d] for d in range(3)]
        d = max(range(3), key=lambda i: widths[i])
        key = (lambda u: (u["dims"][d], u["g"])) if widths[d] > 0 else (lambda u: u["g"])
        half = count // 2
        left = [u for u in us if shard(u) < first + half]
        right = [u for u in us if shard(u) >= first + half]
        assert max(map(key, left)) < min(map(key, right))
        want = sum(u["w"] for u in us) * half / count
        assert abs(sum(u["w"] for u in left) - want) <= largest + s.tolerance * total / shards
        descend(left, first, half)
        descend(right, first + half, count - half)

    descend(units, 0, shards)
    assert all(len({got[i] for i in u["ids"]}) == 1 for u in units)
