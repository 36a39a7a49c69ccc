from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from lodeseek.llm import fuzzy_pairs as Z
from lodeseek.llm import near_sets as N
from lodeseek.llm import simhash as S
from tests.llm.conftest import CLASHING, frame, prose

#: All paths at once: buckets compared two rows deep, shards dealt to several tasks, blocks of three nodes.
NARROW = N.Settings(lags=2, shard_rows=3, block_rows=3)


def sets_of(texts):
    return [set(S.shingles_of((t or "").encode(), 5)) for t in texts]


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute(texts):
    sets, want = sets_of(texts), list(range(len(texts)))
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if near(sets[i], sets[j])]
    for _ in range(len(texts)):
        before = list(want)
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
        if want == before:
            return want, pairs


def family(rng, size, words=150, edits=5):
    base = prose(rng, words).split()
    out = []
    for _ in range(size):
        text = list(base)
        for at in rng.sample(range(words), rng.randint(1, edits)):
            text[at] = f"edit{rng.random()}"
        out.append(" ".join(text))
    return out


def classes(docs, settings=N.Settings()):
    return {r.id: r.component for r in N.near_copies(docs, settings).collect()}


@pytest.mark.parametrize("settings", [N.Settings(), NARROW])
def test_a_nearer_neighbour_that_fails_hides_no_pair(spark, rng, settings):
    """Families of texts around a Jaccard of 0.8: classes are as by brute force, whichever way they are compared."""
    texts = [t for _ in range(12) for t in family(rng, 12)]
    want, _ = brute(texts)
    assert len(set(want)) > 24
    assert classes(frame(spark, texts), settings) == dict(enumerate(want))


@pytest.mark.parametrize("size, families", [(3, 60), (20, 10), (100, 3)])
def test_pairs_of_clusters_stay_together(spark, rng, size, families):
    """Of all pairs at 0.8 or more at least 99 % are in one class, in clusters of any size; no class holds strangers."""
    texts = [t for _ in range(families) for t in family(rng, size, 200, 6)]
    want, pairs = brute(texts)
    got = classes(frame(spark, texts))
    assert all(got[i] // size == i // size for i in got)
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)


def rows_of(fps, label, side, whole, s):
    shard, row = Z.all_shards(fps, s, 0)
    n = np.full(len(fps), 200)
    return Z.Rows(shard, shard, np.arange(len(fps))[row], n[row], fps[row], label[row], side[row], np.full(len(row), whole))


def test_pairs_across_are_all_screened_pairs_once(rng):
    """Fingerprints around one centre: each pair across labels that shares a key and passes the screen, once; with prefix bits as without."""
    s = N.Settings()
    r = np.random.RandomState(4)
    centre = r.randint(0, 1 << 62, s.wide).astype(np.uint64)
    fps = np.array([[c ^ np.uint64(sum(1 << int(b) for b in r.permutation(60)[: r.randint(0, 9)])) for c in centre] for _ in range(60)])
    label, side = np.arange(60) % 3 // 2, np.arange(60) % 2
    limit = Z.bit_limits(s.min_jaccard, s.wide, s.sigmas)[Z.SMALL_SET]
    keys = np.stack([[Z.first_common_key(fps[i : i + 1, t].copy().view(np.int64).repeat(60), fps[:, t].copy().view(np.int64)) for t in range(s.rounds)] for i in range(60)])
    meet = {
        (i, j) for i, j in combinations(range(60), 2)
        if label[i] != label[j] and int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= limit
        and any(keys[i, t, j] >= 0 and int(np.bitwise_count(fps[i, t] ^ fps[j, t])) <= s.max_bits for t in range(s.rounds))
    }
    assert len(meet) > 100
    for whole, want in ((True, meet), (False, {(i, j) for i, j in meet if side[i] != side[j]})):
        got = [tuple(sorted(p)) for u, v in Z.pairs_across(rows_of(fps, label, side, whole, s), 0, s) for p in zip(u.tolist(), v.tolist())]
        assert len(got) == len(set(got)) and set(got) == want
    shard, row = Z.all_shards(fps, s, 3)
    rows = Z.Rows(shard, shard, np.arange(60)[row], np.full(len(row), 200), fps[row], label[row], side[row], np.full(len(row), True))
    got = [tuple(sorted(p)) for u, v in Z.pairs_across(rows, 3, s) for p in zip(u.tolist(), v.tolist())]
    assert len(got) == len(set(got)) and set(got) == meet


def test_limits_of_small_sets_follow_from_counting(rng):
    """Sets of five that share four of five: the share of differing bits is as counted, and the limit lies above it."""
    r = np.random.RandomState(2)
    limits = Z.bit_limits(0.8, 8, 3.3)
    over = 0
    for _ in range(300):
        h = r.randint(0, 1 << 62, 5).astype(np.uint64) * np.uint64(3)
        a, b = S.simhashes([h, h[:4]], 8)
        over += int(np.bitwise_count(a ^ b).sum()) > limits[4]
    assert over <= 3
    assert limits[1] == limits[2] == limits[3] == 0


def test_a_repeated_line_does_not_make_duplicates(spark, rng):
    """A line that fills two texts decides a SimHash of counts; their own words differ, so both stay, and a true copy goes."""
    line = prose(rng, 9)
    one, two = ("\n".join([line] * 60 + [" ".join(f"{x}{i}" for i in range(50))]) for x in "ab")
    texts = [one, two, one + " more", one.replace("\n", "  "), "\n".join([line, one])]
    assert S.fingerprints_of(one.encode(), 5, 2).tolist() == S.fingerprints_of(two.encode(), 5, 2).tolist()
    docs = frame(spark, texts)
    assert {r.doc_id for r in N.keep_one_of_each(docs).collect()} == {0, 1}
    assert classes(docs) == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}


def test_one_of_each_stays(spark, rng):
    base = prose(rng, 300).split()
    close = base[:150] + ["changed"] + base[151:]
    half = base[:150] + prose(rng, 150).split()
    texts = [" ".join(base), prose(rng, 300), " ".join(close), " ".join(base), " ".join(half), None, ""]
    docs = frame(spark, texts, CLASHING)
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 4, 5}
    again = N.keep_one_of_each(docs.unionByName(docs))
    assert sorted(r.doc_id for r in again.collect()) == [0, 1, 4, 5]
    assert N.keep_one_of_each(docs.limit(0)).count() == 0


def test_odd_texts_and_ids(spark, rng, oddities):
    texts = [prose(rng, 300), *oddities]
    docs = frame(spark, texts, CLASHING)
    want, _ = brute(texts)
    assert classes(docs) == dict(enumerate(want))
    unnamed = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "other words here and there now")], "doc_id long, text string")
    assert {r.component for r in N.near_copies(unnamed).collect() if r.id is None} == {3, None}
    kept = [(r.doc_id, r.text) for r in N.keep_one_of_each(unnamed).collect()]
    assert sum(i is None for i, _ in kept) == 3 and (3, "a b c d e f") in kept


def test_pairs_at_the_limit_are_found(spark, rng):
    """200 pairs at a Jaccard of exactly 0.8 (of 225 shingles 25 differ), with the pipeline's settings: 97 % at least are linked."""
    import corpus_pipeline as P

    texts = []
    for _ in range(200):
        words = [f"w{rng.randrange(10**9)}" for _ in range(229)]
        close = list(words)
        for at in range(20, 229, 45):
            close[at] = "edited"
        texts += [" ".join(words), " ".join(close)]
    a, b = (set(S.shingles_of(t.encode(), 5)) for t in texts[:2])
    assert len(a & b) == 0.8 * len(a | b)
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, frame(spark, texts), "").collect()}
    assert kept >= set(range(0, 400, 2)) and len(kept) <= 206


def test_of_rows_that_repeat_an_id_the_same_one_stays(spark):
    rows = [(1, "b b b b b b", "x", "s", 1), (1, "a a a a a a", "y", "s", 2), (1, "a a a a a a", "x", "s", 2), (2, "c d e f g h", "x", "s", 3), (2, "c d e f g h", "x", "s", 3)]
    from tests.llm.conftest import SCHEMA

    kept = {tuple(tuple(r) for r in sorted(N.keep_one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(kept) == 1 and [(r[0], r[1]) for r in kept.pop()] == [(1, "a a a a a a"), (2, "c d e f g h")]
