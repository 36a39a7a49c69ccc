"""Keeping an index fresh: snapshot differences, debounced file events and the update queue.

The reference point for time is the event's own (event time), with a watermark; late events past it are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What a watcher never reports: fixed values, but for the index's own folder.
WATCH_IGNORES = ("node_modules/**", ".git/**", "dist/**", "build/**", ".lodeseek/**", "**/*.log")
DEBOUNCE = "500 milliseconds"


def change_set(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """(key, event) of two snapshots: added, changed or deleted; unchanged keys are left out. One full outer join."""
    old = before.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_in_old"))
    new = after.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_in_new"))
    event = (
        F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return old.join(new, key, "full_outer").select(key, event.alias("event")).where("event IS NOT NULL")


def debounce(events: DataFrame, gap: str = DEBOUNCE, keys: tuple[str, ...] = ("event", "path"), ts: str = "ts") -> DataFrame:
    """The last event of each burst per key (trailing edge): bursts are sessions whose events lie no further apart than the gap.

    On a stream give it a watermark first (withWatermark(ts, ...)); in append mode a burst appears once the watermark passes its end."""
    grouped = events.groupBy(*keys, F.session_window(ts, gap).alias("_s")).agg(F.max(ts).alias("last_ts"), F.count("*").alias("n_events"))
    return grouped.drop("_s")


def queue_items(requests: DataFrame, path: str = "file_path", priority: str = "priority", ts: str = "ts") -> DataFrame:
    """Requests with one row per path, the latest; a missing priority is its time, so newer ones come first."""
    ready = requests.withColumn(priority, F.coalesce(F.col(priority), F.col(ts).cast("long")))
    others = [c for c in ready.columns if c != path]
    latest = ready.groupBy(path).agg(F.max_by(F.struct(*others), F.struct(ts, priority)).alias("_r"))
    return latest.select(path, "_r.*")


def drain(items: DataFrame, n: int = 1, priority: str = "priority", ts: str = "ts", path: str = "file_path") -> DataFrame:
    """The next n items: highest priority, then newest."""
    return items.orderBy(F.desc(priority), F.desc(ts), path).limit(n)


def watch(
    events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, watermark: str = "10 seconds", gap: str = DEBOUNCE, interval: str | None = "1 second"
) -> StreamingQuery:
    """Starts a stream that hands each micro-batch of debounced events to apply(batch, epoch). Without interval: what is there, then stop."""
    settled = debounce(events.withWatermark("ts", watermark), gap)
    writer = settled.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, window: str, slide: str | None = None, watermark: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and mean values per event-time window; the watermark only matters on a stream."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), *keys, "n", "total"
    )
