from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.admin import config, embedding, telemetry
from lodeseek.admin.cache import QueryCache
from lodeseek.admin.errors import ConfigInvalid, NotFound, as_engine_error
from lodeseek.admin.status import HealthChecker


def test_cache_expires_evicts_and_counts():
    now = [0.0]
    c = QueryCache(2, 10, lambda: now[0])
    c.set(" A ", [1.0])
    assert c.get("a") == [1.0] and c.get("b") is None and c.stats().hit_rate == 0.5
    now[0] = 9
    assert c.has("a")  # refreshes
    now[0] = 18
    assert c.get("a") == [1.0]
    c.set("b", [2.0]), c.set("c", [3.0])
    assert not c.has("a") and c.stats().size == 2
    now[0] = 40
    assert c.get("c") is None


def test_config_layers_and_checks(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"search": {"bm25Weight": 0.5}, "telemetry": {"enabled": True}}))
    got = config.load(str(path), {"LODESEEK_MODE": "cloud"})
    assert got["mode"] == "cloud" and got["search"] == {"bm25Weight": 0.5, "vectorWeight": 0.7} and got["telemetry"]["enabled"]
    assert config.check(got) and len(config.mode_warnings(got)) == 2
    with pytest.raises(ConfigInvalid):
        config.load(None, {"LODESEEK_MODE": "elsewhere"})
    with pytest.raises(ConfigInvalid):
        config.preset("cloud", {"provider": "openai"})
    config.save(config.preset("local"), str(tmp_path / "d.json"))
    with pytest.raises(ConfigInvalid):
        config.save(config.preset("local"), str(tmp_path / "d.json"))


def test_embedders(spark):
    e = embedding.CachedEmbedder(embedding.HashingEmbedder(16))
    assert e.dimension() == 0
    e.initialize()
    assert np.isclose(np.linalg.norm(e.embed("alpha beta")), 1) and e.embed("alpha beta") == e.embed(" ALPHA beta") and e.stats().hits == 2
    df = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    got = [r.vector for r in embedding.with_vectors(df, 16).collect()]
    assert np.allclose(got[0], e.embed("alpha beta"), atol=1e-6) and not any(got[1])


def test_hosted_embedder_waits_and_gives_up():
    waits, calls = [], []

    def transport(texts, model, key):
        calls.append(len(texts))
        if len(calls) < 3:
            raise embedding.HostedEmbedder.Refused
        return [[1.0]] * len(texts)

    e = embedding.HostedEmbedder("m", "k", transport, batch=2, sleep=waits.append)
    e.initialize()
    assert e.embed_batch(["a", "b", "c"]) == [[1.0]] * 3 and waits == [0.1, 0.2] and e.dimension() == 1536
    with pytest.raises(ConfigInvalid):
        embedding.HostedEmbedder("m", "${NOT_SET_ANYWHERE}", transport).initialize()


def test_health_keeps_an_answer():
    now, asked = [0.0], []

    def store():
        asked.append(1)
        raise ValueError("down")

    h = HealthChecker("1", store, lambda: [1.0], 30, lambda: now[0])
    assert h.check()["status"] == "degraded" and h.check()["status"] == "degraded" and len(asked) == 1
    now[0] = 31
    h.check()
    assert len(asked) == 2


def test_telemetry_spans_nest_and_redact():
    spans = []
    t = telemetry.Telemetry(True, 1.0, spans.append)
    with t.span("outer", query="x" * 2000) as outer, pytest.raises(KeyError):
        headers = telemetry.inject()
        with t.span("inner"):
            raise KeyError("k")
    assert [s.name for s in spans] == ["inner", "outer"] and spans[0].trace_id == outer.trace_id and spans[0].error
    assert telemetry.extract(headers) == (outer.trace_id, outer.span_id) and len(outer.attributes["query"]) == 1027
    assert telemetry.redacted({"apiKey": 1, "a": [{"my_token": 2, "b": 3}]}) == {"apiKey": "***", "a": [{"my_token": "***", "b": 3}]}
    off = telemetry.Telemetry()
    off.count("x")
    assert not off.counts and off.traced("n")(lambda: 5)() == 5


def test_errors():
    assert NotFound("gone", suggestion="index it").to_dict() == {"code": -32001, "message": "gone", "suggestion": "index it"}
    assert as_engine_error(ValueError("x")).code == -32603


def test_counts_of_executors_are_those_of_the_rows_written(spark, tmp_path):
    telemetry_ = telemetry.Telemetry(enabled=True)
    metrics = telemetry.Metrics(telemetry_)
    rows = spark.range(1000).repartition(7).withColumn("even", F.col("id") % 2 == 0)
    with metrics.measured(rows, "written", rows=F.count(F.lit(1)), even=F.count_if("even"), most=F.max("id")) as counted:
        counted.df.write.parquet(f"{tmp_path}/rows")
    assert counted.values == {"rows": 1000, "even": 500, "most": 999} and spark.read.parquet(f"{tmp_path}/rows").count() == 1000
    assert telemetry_.read()["counters"]["written.rows"] == 1000
    with metrics.measured(rows.where("id < 0"), "empty", rows=F.count(F.lit(1)), most=F.max("id")) as counted:
        counted.df.write.parquet(f"{tmp_path}/none")
    assert counted.values == {"rows": 0, "most": None}
    with pytest.raises(RuntimeError), metrics.measured(rows, "failed", rows=F.count(F.lit(1))):
        raise RuntimeError
    assert "failed.rows" not in telemetry_.read()["counters"]
    with telemetry.Metrics().measured(rows, "off", rows=F.count(F.lit(1))) as counted:
        counted.df.collect()
    assert counted.values == {"rows": 1000}
