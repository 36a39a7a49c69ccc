from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import hybrid, vectors


def rows(spark, n=300, d=8, seed=0):
    x = np.random.RandomState(seed).randn(n, d)
    return x, spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")


def test_top_k_is_exact(spark):
    x, df = rows(spark)
    q = x[7] + 0.1
    want = np.argsort(((x - q) ** 2).sum(1))[:5].tolist()
    assert [r.id for r in vectors.top_k(df, q, 5).collect()] == want
    cos = (x @ q) / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    assert [r.id for r in vectors.top_k(df, q, 5, "cosine").collect()] == np.argsort(-cos)[:5].tolist()


def test_cells_reach_recall(spark):
    x, df = rows(spark)
    centers = vectors.fit_cells(df, cells=6)
    celled = vectors.with_cell(df, centers)
    hit = 0
    for i in range(0, 300, 50):
        want = set(np.argsort(((x - x[i]) ** 2).sum(1))[:10].tolist())
        hit += len(want & {r.id for r in vectors.top_k_in_cells(celled, centers, x[i], 10, probes=5).collect()})
    assert hit / 60 >= 0.9


def test_zero_vector_has_cosine_zero(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert vectors.top_k(df, [1.0, 0.0], 1, "cosine").first().score == 0.0


def test_upsert_and_delete(spark):
    _, df = rows(spark, 10)
    new = df.where("vec_id < 2").withColumn("label", F.lit(9))
    out = vectors.upsert(df, new)
    assert out.count() == 10 and out.where("label = 9").count() == 2
    assert vectors.delete(out, spark.createDataFrame([(0,), (77,)], "vec_id long")).count() == 9


@pytest.mark.parametrize("scores, want", [([5.0, 10.0, 2.5], [1 / 3, 1.0, 0.0]), ([2.0, 2.0], [1.0, 1.0]), ([7.0], [1.0]), ([], [])])
def test_min_max(spark, scores, want):
    df = spark.createDataFrame(list(enumerate(scores)), "id int, score double")
    got = [r.norm for r in hybrid.min_max(df).orderBy("id").collect()]
    assert np.allclose(got, want)


def test_hybrid_fills_missing_arms_and_filters_after_the_cut(spark):
    kw = spark.createDataFrame([("a", 4.0), ("b", 2.0)], "id string, score double")
    vec = spark.createDataFrame([("b", 0.9), ("c", 0.5)], "id string, score double")
    got = {r.id: r.score for r in hybrid.search(kw, vec, 10).collect()}
    assert np.isclose(got["a"], 0.3) and np.isclose(got["b"], 0.3 * 0.5 + 0.7) and np.isclose(got["c"], 0.7 * 0.5 / 0.9)
    meta = spark.createDataFrame([("a", "en", "ts"), ("b", "EN", "py")], "id string, language string, file_type string")
    f = hybrid.Filter(languages=["en"], ignore_case=True)
    assert {r.id for r in hybrid.search(kw, vec, 10, metadata=meta, where=f).collect()} == {"a", "b"}
    assert {r.id for r in hybrid.search(kw, vec, 10, metadata=meta, where=hybrid.Filter(file_types=[".ts"])).collect()} == {"a"}


def test_an_arm_without_hits_counts_one(spark):
    kw = spark.createDataFrame([], "id string, score double")
    vec = spark.createDataFrame([("b", 0.9), ("c", 0.5)], "id string, score double")
    assert np.isclose(hybrid.search(kw, vec, 10).where("id = 'b'").first().score, 1.0)


def test_alpha_is_checked():
    with pytest.raises(ValueError):
        hybrid.Mix(1.2)
