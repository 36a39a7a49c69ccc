from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
import xxhash

from lodeseek.llm import golay
from lodeseek.llm import simhash as S
from lodeseek.llm.components import connected_components
from tests.llm.conftest import CLASHING, frame, prose


def test_the_code_is_perfect():
    words = np.random.RandomState(0).randint(0, 1 << 23, 5000)
    codes, n = golay.keys(words)
    assert set(n.tolist()) <= {1, 6}
    near = golay.decode(words)
    assert all(a in set(row[:k].tolist()) for a, row, k in zip(near, codes, n))
    for row, k in zip(codes, n):
        assert len(set(row[:k].tolist())) == k


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_words_within_two_bits_share_a_key(bits):
    rng = np.random.RandomState(bits)
    words = rng.randint(0, 1 << 23, 1500)
    other = words.copy()
    for i in range(len(words)):
        for b in rng.permutation(23)[:bits]:
            other[i] ^= 1 << b
    (a, na), (b, nb) = golay.keys(words), golay.keys(other)
    assert all(set(x[:k]) & set(y[:m]) for x, k, y, m in zip(a, na, b, nb))


def brute(fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bits", [3, 5])
@pytest.mark.parametrize("narrow", [{}, {"lags": 2}, {"lags": 2, "block_rows": 7}, {"shard_rows": 20, "block_rows": 10}])
def test_links_connect_as_brute_force(spark, bits, narrow):
    """Random fingerprints and dense clusters, whether buckets and shards are compared at once, in parts or in pairs of blocks."""
    rng = np.random.RandomState(bits)
    fps = [int(x) for x in rng.randint(0, 1 << 62, 150)]
    for center in fps[:4]:
        fps += [center ^ sum(1 << int(b) for b in rng.permutation(14)[: rng.randint(1, 6)]) for _ in range(60)]
    fps = sorted(set(fps))
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    got = {r.node: r.component for r in S.classes(nodes, bits, **narrow).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == brute(fps, bits)


def test_a_chain_within_the_limit_is_one_class(spark):
    """Each fingerprint differs from the next in three bits, from the one after in six."""
    fps = [0]
    for i in range(20):
        fps.append(fps[-1] ^ (7 << (3 * i)))
    got = {r.node: r.component for r in S.classes(spark.createDataFrame(list(enumerate(fps)), "node long, fp long"), 3).collect()}
    assert got == {i: 0 for i in range(1, 21)}
    assert S.classes(spark.createDataFrame(list(enumerate(fps)), "node long, fp long"), 2).count() == 0
    with pytest.raises(ValueError):
        S.classes(spark.createDataFrame([], "node long, fp long"), 6)


def test_shingles_do_not_hang_on_blocks(rng):
    for n in (0, 1, 2, 3, 10, 11, 12, 25):
        text = " ".join(f"W{i}" for i in range(n)).encode()
        words = text.lower().split()
        want = [b" ".join(words[i : i + 3]) for i in range(n - 2)] if n >= 3 else [b" ".join(words)] if n else []
        for block in (1, 4, 10, 65_536):
            assert [x for b in S.shingle_blocks(text, 3, block) for x in b] == want


def test_fingerprint_by_definition():
    text = "One two  Three\tfour\nfive one two three"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert S.fingerprint_of(text.encode(), 3) == want
    assert S.fingerprint_of(b"A b", 3) == xxhash.xxh64_intdigest(b"a b", 42) and S.fingerprint_of(b" \n", 3) == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)] + [(200, 201), (201, 202), (202, 200)]
    for per_task in (1000, 7):  # at once, and by stars of parts
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(40), per_task).collect()}
        assert got == {**{i: 10 for i in range(11, 61)}, **{i: 100 for i in range(101, 160)}, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_over_a_table(spark, rng, oddities):
    base = prose(rng, 400)
    texts = [prose(rng, 300), base, base, base + " kana", prose(rng, 200), *oddities]
    docs = frame(spark, texts, CLASHING)
    got = {r.id: r for r in S.near_duplicates(docs).collect()}
    fps = [S.fingerprint_of((t or "").encode(), 3) for t in texts]
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i].component for i in range(len(texts))] == brute(fps, 3)
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_bits_are_counted_alike_in_lists_of_any_length():
    h = np.random.RandomState(1).randint(0, 1 << 62, 70_000).astype(np.uint64) * np.uint64(3)
    lists = [h[:n] for n in (0, 1, 254, 255, 256, 511, 70_000, 0)]
    for found, part in zip(S.simhashes(lists, 2), lists):
        want = sum(1 << b for b in range(64) if 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > len(part))
        assert int(found[0]) == want
