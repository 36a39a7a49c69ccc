"""Totals, status, sizes, health and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseek.admin import status
from lodeseek.admin.telemetry import Metrics, Telemetry
from lodeseek.operators import bm25
from lodeseek.plans.registry import Registry
from lodeseek.plans.search_queries import TOKENS
from lodeseek.session import materialize, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("""SELECT (count(*) FILTER (WHERE quality = 1))::BIGINT AS indexed_files, (count(*) FILTER (WHERE quality <> 1))::BIGINT AS failed_files,
sum(doc_id % 13)::BIGINT AS total_symbols, sum(doc_id % 17)::BIGINT AS total_vectors,
list('e' || doc_id ORDER BY 'e' || doc_id) FILTER (WHERE quality <> 1) AS errors FROM labels""")
def index_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(
        (F.col("quality") == 1).alias("success"), (F.col("doc_id") % 13).alias("symbols"), (F.col("doc_id") % 17).alias("vectors"),
        F.when(F.col("quality") != 1, F.concat(F.lit("e"), F.col("doc_id").cast("string"))).alias("error"),
    )
    return status.project_totals(rows)


_META = """m AS (SELECT source AS project_id, count(*)::BIGINT AS total_files, sum(n_chars)::BIGINT AS total_symbols FROM documents GROUP BY source)"""


def _metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project_id")).agg(F.count("*").alias("total_files"), F.sum("n_chars").alias("total_symbols"))
    null = lambda kind: F.lit(None).cast(kind)
    return rows.select("project_id", null("string").alias("root_path"), F.lit("indexed").alias("status"), null("timestamp").alias("last_indexed"), "total_files", "total_symbols", F.col("total_files").alias("total_vectors"))


@R.add(f"WITH {_META} SELECT project_id, 'indexed' AS status, total_files FROM m")
def index_status(spark, sf_dir):
    return status.status_of(_metadata(spark, sf_dir)).select("project_id", "status", "total_files")


@R.add("SELECT 'nowhere' AS project_id, 'indexed' AS status, 0::BIGINT AS total_files")
def index_status_unknown(spark, sf_dir):
    return status.status_of(_metadata(spark, sf_dir), "nowhere").select("project_id", "status", "total_files")


@R.add(f"WITH {_META} SELECT project_id, CASE WHEN project_id = 'src1' THEN 'error' ELSE 'indexed' END AS status, total_files FROM m UNION ALL SELECT 'fresh', 'indexing', NULL")
def index_metadata_merge(spark, sf_dir):
    current = _metadata(spark, sf_dir)
    new = current.where("project_id = 'src1'").withColumn("status", F.lit("error")).withColumn("total_files", F.lit(None).cast("long"))
    fresh = current.limit(1).withColumn("project_id", F.lit("fresh")).withColumn("status", F.lit("indexing")).withColumn("total_files", F.lit(None).cast("long"))
    return status.upsert_metadata(current, new.unionByName(fresh)).select("project_id", "status", "total_files")


@R.add(f"WITH {_META} SELECT project_id, (total_files * 384 * 4 + total_files * 200 + total_symbols * 100)::BIGINT AS bytes FROM m")
def index_size_estimate(spark, sf_dir):
    return _metadata(spark, sf_dir).select("project_id", status.index_size(F.col("total_vectors"), F.col("total_symbols")).alias("bytes"))


@R.add("""SELECT user_id % 10 AS shard, round(CASE WHEN count(*) = 0 THEN 0 ELSE (count(*) FILTER (WHERE event_type = 'view')) / count(*) END, 6) AS hit_rate FROM events GROUP BY 1""")
def cache_hit_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("shard")).agg(F.count_if(F.col("event_type") == "view").alias("h"), F.count("*").alias("n"))
    return rows.select("shard", F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.col("h") / F.col("n")), 6).alias("hit_rate"))


@R.add("""SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 = 0 THEN 'healthy' WHEN conv_id % 2 <> 0 AND conv_id % 3 <> 0 THEN 'unhealthy' ELSE 'degraded' END AS health
FROM (SELECT DISTINCT conv_id FROM conversations)""")
def health_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    probe = lambda n: F.when(F.col("conv_id") % n == 0, "up").otherwise("down")
    return rows.select("conv_id", status.overall_health(probe(2), probe(3)).alias("health"))


@R.add("SELECT user_id, count(*)::BIGINT AS requests, (count(*) FILTER (WHERE event_type = 'error'))::BIGINT AS errors FROM events GROUP BY user_id")
def telemetry_counters(spark, sf_dir):
    return status.counters(table(spark, sf_dir, "events"), "user_id")


@R.add("""SELECT event_type, CASE WHEN value <= 5 THEN 5.0 WHEN value <= 10 THEN 10.0 WHEN value <= 25 THEN 25.0 WHEN value <= 50 THEN 50.0 WHEN value <= 100 THEN 100.0
WHEN value <= 250 THEN 250.0 WHEN value <= 500 THEN 500.0 WHEN value <= 1000 THEN 1000.0 END::DOUBLE AS le, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def latency_histogram(spark, sf_dir):
    return status.latency_histogram(table(spark, sf_dir, "events"), "event_type", "value")


@R.add("SELECT doc_id FROM documents WHERE source <> 'src0'")
def clear_index(spark, sf_dir):
    """What is left of an index after one project is cleared: an anti-join on its documents."""
    from lodeseek.operators.vectors import delete

    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return delete(d, d.where("source = 'src0'"), "doc_id").select("doc_id")


@R.add(f"""WITH {TOKENS} SELECT count(*)::BIGINT AS documents, sum(len(ts))::BIGINT AS tokens, max(len(ts))::BIGINT AS longest,
count(*) FILTER (WHERE len(ts) = 0)::BIGINT AS without_tokens FROM toks""")
def executor_metrics(spark, sf_dir):
    """What executors counted while one job wrote the documents' lengths, with no pass of its own; the row is made of the counts."""
    lengths, length = bm25.doc_stats(table(spark, sf_dir, "documents")), F.col("length")
    metrics = Metrics(Telemetry(enabled=True))
    counts = {"documents": F.count(F.lit(1)), "tokens": F.sum(length), "longest": F.max(length), "without_tokens": F.count_if(length == 0)}
    with metrics.measured(lengths, "lodeseek.index", **counts) as counted:
        materialize(counted.df, "lengths")
    return spark.createDataFrame([tuple(counted.values[n] for n in counts)], ", ".join(f"{n} long" for n in counts))
