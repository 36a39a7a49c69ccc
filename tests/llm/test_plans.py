from __future__ import annotations

from lodeseek.llm import license_scan


def test_the_native_operator_runs_no_python(spark):
    docs = spark.range(2).selectExpr("id AS doc_id", "'mit license' AS text")
    df = license_scan.scan(docs)
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert not any(word in text for word in ("MapIn", "EvalPython", "PythonUDF", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoop"))
    lineage = df._jdf.queryExecution().toRdd().toDebugString()
    assert "Python" not in lineage
