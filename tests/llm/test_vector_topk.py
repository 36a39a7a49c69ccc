from __future__ import annotations

import math

import pytest

from lodeseek.llm import vector_topk as T


def clip(score):
    return max(-(2**63) + 1, min(2**63 - 1, score))


def brute(vectors, queries, k):
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = []
    for q in queries:
        if q in whole:
            mine = max(whole[q])
            scores = [(-clip(sum(a * b for a, b in zip(mine, v))), i) for i, vs in whole.items() for v in vs if i != q]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def answer(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}").selectExpr("*", "'x' AS id", "1 AS v", "2 AS cell", "3 AS kind")


def vectors_of(rng, n, width=9, zero=0.4):
    quarter = lambda: rng.randint(-4000, 4000) / 1024
    return [(i, [0.0 if rng.random() < zero else quarter() for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("group_bytes", [32 << 20, 900])
def test_as_by_brute_force(spark, rng, group_bytes):
    rows = vectors_of(rng, 400) + [(1000 + i, [1.0] * 9) for i in range(150)]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf"), 1.0]), (2004, []), (2005, [0.5] * 3), (None, [9.0] * 9), (2006, [-0.0007] * 9)]
    df = table(spark, rows)
    got = T.top_k(df, df.where("vec_id % 20 = 0"), 10, group_bytes=group_bytes)
    assert answer(got) == brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 10)


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])]
    df = table(spark, rows)
    assert answer(T.top_k(df, df.where("vec_id = 0"), 3)) == brute(rows, {0}, 3)


def test_large_components_are_summed_in_whole_numbers(spark):
    big = [(0, [2.0**20 + 0.5, 3.0**20, -7.0]), (1, [3.0**19, 1.0, 2.0**21]), (2, [3.0**19, 1.0 + 2**-9, 2.0**21]), (3, [1e300, 1.0, 1.0]), (4, [-1e300, 0.0, 0.0]), (5, [1e307, 0.0, 0.0])]
    df = table(spark, big, "array<double>")
    assert answer(T.top_k(df, df, 10)) == brute(big[:5], {0, 1, 2, 3, 4}, 10)


def test_fewer_than_k_and_none(spark):
    df = table(spark, [(100, [1.0]), (1, [2.0])])
    assert answer(T.top_k(df, df.where("vec_id % 100 = 0"))) == [(100, 1, 1, 1024 * 2048)]
    assert answer(T.top_k(df.limit(0), df)) == [] and answer(T.top_k(df, df.limit(0))) == []
