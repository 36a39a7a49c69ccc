"""Toxicity (factorization machine) and quality (nearest neighbours)."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from lodeseek.llm import quality, toxicity
from tests.llm.conftest import CLASHING, frame, prose


def labelled(spark, rng, n=600):
    """Toxic only where an insult meets a group's name; low quality where punctuation fills the text."""
    texts, toxic, good = [], [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 60)).split()
        kind = i % 4
        if kind in (0, 1):
            words.insert(rng.randrange(len(words)), "fool")
        if kind in (0, 2):
            words.insert(rng.randrange(len(words)), "martians")
        toxic.append(int(kind == 0))
        good.append(int(i % 3 > 0))
        texts.append(" ".join(words) if i % 3 else " ".join(w + "$$%" for w in words))
    labels = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic))], "doc_id long, quality int, toxic int")
    return frame(spark, texts, CLASHING), labels, np.array(toxic), np.array(good)


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_machine_learns_an_interaction(spark, rng):
    docs, labels, toxic, _ = labelled(spark, rng)
    model = toxicity.fit(docs, labels, settings=toxicity.Settings(epochs=400))
    got = {r.id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 600 and all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 for i in got)
    right = np.mean([(got[i].score >= 0.5) == toxic[i] for i in got if got[i].held_out])
    assert right >= 0.95
    insult, group, both = (model.score(model.slot[toxicity.terms_of(t, 18)][model.slot[toxicity.terms_of(t, 18)] >= 0]) for t in (b"fool", b"martians", b"fool martians"))
    assert both > 0.5 > max(insult, group)


def test_held_out_labels_change_nothing(spark, rng):
    docs, labels, *_ = labelled(spark, rng, 200)
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x, settings=toxicity.Settings(epochs=30)) for x in (labels, other))
    assert np.array_equal(a.linear, b.linear) and a.bias == b.bias


def test_column_and_table_agree(spark, rng):
    docs, labels, *_ = labelled(spark, rng, 120)
    model = toxicity.fit(docs, labels, settings=toxicity.Settings(epochs=20))
    by_table = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    column = toxicity.score_column(docs, model)
    assert {r.doc_id: r.s for r in docs.select("doc_id", column(docs["text"]).alias("s")).collect()} == by_table


def test_neighbours_judge_quality(spark, rng):
    docs, labels, _, good = labelled(spark, rng)
    got = {r.id: r for r in quality.score(docs, quality.fit(docs, labels, settings=quality.Settings(neighbours=9))).collect()}
    assert np.mean([(got[i].score >= 0.5) == good[i] for i in got if got[i].held_out]) >= 0.95


def test_votes_match_brute_force():
    rng = np.random.RandomState(0)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = quality.Settings(neighbours=5, block=7)
    model = quality.Model(np.zeros(2), np.zeros((2, 2)), unit(rng.randn(40, 6)), rng.randint(0, 2, 40).astype(float), 0.5, s)
    asked = unit(rng.randn(23, 6))
    for got, v in zip(model.vote(asked), asked):
        cos = model.vectors @ v
        near = np.argsort(-cos)[:5]
        w = np.maximum(cos[near], 0).astype(float) ** s.sharpness
        assert got == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-6)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_texts_and_no_labels(spark, oddities, module, label):
    docs = frame(spark, oddities, CLASHING)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        got = module.score(docs, module.fit(docs, labels, label)).collect()
        assert len(got) == len(oddities) and all(0 <= r.score <= 1 for r in got)
        assert got[3].score == got[4].score and got[0].score == got[1].score
    assert module.score(docs.limit(0), module.fit(docs.limit(0), none, label)).count() == 0


def test_scores_match_the_sum_over_all_pairs(spark, rng):
    """The machine by its definition: bias, weights and the product of factors of every pair of a text's features; the features are
    the terms of the largest chi-squared, counted over the learning rows."""
    docs, labels, toxic, _ = labelled(spark, rng, 200)
    s = toxicity.Settings(epochs=40, features=30)
    model = toxicity.fit(docs, labels, settings=s)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    learn = [i for i in texts if not held(i)]
    n, n1 = len(learn), sum(int(toxic[i]) for i in learn)
    count = {}
    for i in learn:
        for t in toxicity.terms_of(texts[i].encode(), s.hash_bits).tolist():
            a, b = count.get(t, (0, 0))
            count[t] = (a + 1, b + int(toxic[i]))
    chi = {t: (b * (n - n1) - (a - b) * n1) ** 2 / (a * (n + 1 - a)) for t, (a, b) in count.items() if a >= s.min_rows}
    best = sorted(chi, key=lambda t: (-chi[t], t))[: s.features]
    assert set(np.flatnonzero(model.slot >= 0).tolist()) == set(best)
    got = {r.id: r.score for r in toxicity.score(docs.unionByName(docs), model).collect()}
    assert toxicity.score(docs.unionByName(docs), model).distinct().count() == 200
    for i, text in texts.items():
        on = [int(model.slot[t]) for t in set(toxicity.terms_of(text.encode(), s.hash_bits).tolist()) if model.slot[t] >= 0]
        z = model.bias + sum(float(model.linear[f]) for f in on)
        z += sum(float(model.factors[f].astype(float) @ model.factors[g].astype(float)) for k, f in enumerate(on) for g in on[k + 1 :])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_neighbours_that_tie_count_in_order():
    """Rows 1 to 4 are equally near and two places are left beside row 0: rows 1 and 2 have them, in blocks of any size."""
    vectors = np.array([[1, 0], [0.8, 0.6], [0.8, 0.6], [0.8, 0.6], [0.8, 0.6], [0, 1]], dtype=np.float32)
    asked = np.repeat(np.array([[1, 0]], dtype=np.float32), 9, axis=0)
    found = []
    for block in (1, 4, 100):
        s = quality.Settings(neighbours=3, block=block)
        model = quality.Model(np.zeros(2), np.zeros((2, 2)), vectors, np.array([0, 1, 1, 0, 0, 0.0]), 0.5, s)
        found.append(model.vote(asked))
        near = 0.8**s.sharpness
        assert found[-1] == pytest.approx(2 * near / (1 + 2 * near), abs=1e-5)
    assert np.allclose(found[0], found[2], atol=1e-7)
