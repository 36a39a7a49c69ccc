"""File-change operators over the events table, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.plans.registry import Registry
from lodeseek.session import scratch_root, table
from lodeseek.streaming import changes, durable_queue

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

GAP, GAP_SQL = "9 hours", "INTERVAL 9 HOUR"
_SESSIONS = f"""s AS (SELECT event_type AS event, user_id % 200 AS path, ts, lag(ts) OVER (PARTITION BY event_type, user_id % 200 ORDER BY ts) AS p FROM events),
n AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > {GAP_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY event, path ORDER BY ts, p) AS run FROM s),
g AS (SELECT event, path, max(ts) AS last_ts, count(*)::BIGINT AS n_events FROM n GROUP BY event, path, run)"""


def file_events(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_type").alias("event"), (F.col("user_id") % 200).alias("path"), "ts")


@R.add(f"WITH {_SESSIONS} SELECT * FROM g")
def debounce_events(spark, sf_dir):
    return changes.debounce(file_events(table(spark, sf_dir, "events")), GAP)


def stream_of(spark, sf_dir, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@R.add(f"""WITH {_SESSIONS} SELECT * FROM g
WHERE last_ts + {GAP_SQL} <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 SECOND""")
def debounce_stream(spark, sf_dir):
    """The same as a stream in append mode: bursts appear once the watermark has passed their end."""
    root = f"{scratch_root(spark)}/lodeseek/stream-{uuid.uuid4().hex}"
    events = file_events(stream_of(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need the zoned type
    query = changes.watch(
        events, lambda batch, epoch: batch.write.mode("append").parquet(f"{root}/out"), f"{root}/state", gap=GAP, interval=None
    )
    query.awaitTermination()
    found = spark.read.schema("event string, path long, last_ts timestamp, n_events long").parquet(f"{root}/out")
    return found.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@R.add(f"""WITH s AS (SELECT (user_id % 200)::VARCHAR AS file_path, event_type AS project_id, (event_id % 9)::DOUBLE AS priority, ts, lag(ts) OVER (PARTITION BY user_id % 200 ORDER BY ts) AS p FROM events),
n AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > {GAP_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY ts, p) AS run FROM s),
g AS (SELECT file_path, first(project_id ORDER BY ts DESC, priority DESC, project_id DESC) AS project_id, first(priority ORDER BY ts DESC, priority DESC, project_id DESC) AS priority, max(ts) AS ts, count(*)::BIGINT AS n_requests
  FROM n GROUP BY file_path, run)
SELECT * FROM g WHERE ts + {GAP_SQL} <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 SECOND""")
def durable_queue_items(spark, sf_dir):
    """Events as update requests: what the queue hands on, through state and timers, once a path has kept still for the gap."""
    root = f"{scratch_root(spark)}/lodeseek/queue-{uuid.uuid4().hex}"
    events = stream_of(spark, sf_dir, "events")
    requests = events.select((F.col("user_id") % 200).cast("string").alias("file_path"), F.col("event_type").alias("project_id"), (F.col("event_id") % 9).alias("priority"), F.col("ts").cast("timestamp").alias("ts"))

    def keep(items: DataFrame, epoch: int) -> None:
        items.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    durable_queue.run_queue(requests, keep, f"{root}/errors", f"{root}/state", GAP, interval=None).awaitTermination()
    found = spark.read.schema("file_path string, project_id string, priority double, ts timestamp, n_requests long").parquet(f"{root}/out")
    return found.select("file_path", "project_id", "priority", F.col("ts").cast("timestamp_ntz").alias("ts"), "n_requests")


@R.add("""SELECT user_id AS file_path, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY user_id""")
def queue_dedup_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_path"), "event_id", "ts", F.lit(None).cast("long").alias("priority"))
    return changes.queue_items(e.withColumn("ts", F.col("ts").cast("timestamp"))).select("file_path", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@R.add("""WITH q AS (SELECT user_id AS file_path, arg_max(struct_pack(p := (event_id % 9)::BIGINT, ts := ts), ts) AS r FROM events GROUP BY user_id)
SELECT file_path, r.p AS priority, r.ts AS ts FROM q ORDER BY r.p DESC, r.ts DESC, file_path LIMIT 25""")
def queue_priority_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_path"), (F.col("event_id") % 9).alias("priority"), F.col("ts").cast("timestamp").alias("ts"))
    return changes.drain(changes.queue_items(e), 25).select("file_path", "priority", F.col("ts").cast("timestamp_ntz").alias("ts"))


@R.add("""WITH o AS (SELECT doc_id AS path, md5(text) AS d FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS d FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS event
FROM o FULL JOIN n USING (path) WHERE o.d IS DISTINCT FROM n.d""")
def change_set_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    before = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.md5("text").alias("digest"))
    text = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = d.where("doc_id % 10 <> 2").select(F.col("doc_id").alias("path"), F.md5(text).alias("digest"))
    return changes.change_set(before, after)


@R.add("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_event_counts(spark, sf_dir):
    rows = changes.windowed_counts(table(spark, sf_dir, "events"), "1 hour")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
