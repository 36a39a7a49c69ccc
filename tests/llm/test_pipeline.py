"""The pipeline's stages, each on what the one before kept, against plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from lodeseek.llm import decontaminate, packing, secret_scan, simhash
from tests.llm.conftest import CLASHING, frame, prose


def test_stages(spark, rng, tmp_path):
    item = " ".join(f"bench{i}" for i in range(20))
    base = prose(rng, 300)
    texts = [base, base, base + " tail", prose(rng, 80) + " " + item, "token = deadbeefdeadbeefdeadbeef00 " + prose(rng, 60), None, ""]
    texts += [prose(rng, 60) + (" fool" if i % 5 == 0 else "") for i in range(300)]
    docs = frame(spark, texts)
    toxic = {i for i, t in enumerate(texts) if t and "fool" in t}
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(0, item)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")

    now, seen = docs, []
    for name, stage in C.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(now)
        if name != C.STAGES[-1][0]:
            assert now.columns == docs.columns
    kept = [{r.doc_id: r.text for r in x.collect()} for x in seen[:-1]]

    assert set(kept[0]) == set(range(len(texts))) - toxic
    sets = {i: set(simhash.shingles_of((t or "").encode(), 5)) for i, t in kept[0].items()}
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    first = {i for i in sets if not any(j < i and alike(sets[i], sets[j]) for j in sets)}
    assert set(kept[1]) == first
    leaky = {i for i, t in kept[1].items() if decontaminate.best_span(item.encode().split(), decontaminate.words_of((t or "").encode()))[0] <= 4}
    assert leaky == {3} and set(kept[2]) == first - leaky
    assert kept[3].keys() == kept[2].keys()
    assert all(t is None or not secret_scan.find_spans(t) for t in kept[3].values()) and kept[3][4].startswith("[secret]")
    assert all(kept[3][i] == texts[i] for i in kept[3] if i != 4)
    packed = now.groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id: r["sum(length)"] for r in packed} == {i: len(packing.ids_of(t, packing.default_vocabulary())) for i, t in kept[3].items()}
    assert np.max([r.offset + r.length for r in now.collect()]) <= 1024
    assert C.run(spark, str(tmp_path)).count() == now.count()


def test_no_rows(spark, tmp_path):
    empty = frame(spark, [])
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stages_survive_odd_rows(spark, rng, oddities, tmp_path):
    """Nulls in every column, repeated rows, very long texts and columns of clashing names: each stage keeps the columns and whole rows."""
    item = " ".join(f"bench{i}" for i in range(20))
    texts = [prose(rng, 60) + (" fool" if i % 5 == 0 else "") for i in range(100)] + oddities
    docs = frame(spark, texts, CLASHING.replace("id ", "") + " u v n same node label item_id")
    blank = docs.select(*(docs[c] if c in ("doc_id", "text") else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes)).limit(5)
    docs = docs.unionByName(docs).unionByName(blank)
    labels = spark.createDataFrame([(i, 1, int("fool" in texts[i])) for i in range(100)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = sorted((r.doc_id, r.text or "") for r in docs.collect())
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = sorted((r.doc_id, r.text or "") for r in out.select("doc_id", "text").collect())
        if name in ("decontamination", "secret_scan"):
            assert rows == before, name
        assert set(rows) <= set(before)
    assert C.pack_windows(spark, docs, str(tmp_path)).groupBy("doc_id").count().count() == len(texts)
