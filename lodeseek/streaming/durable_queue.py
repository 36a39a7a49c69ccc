"""The update queue as a stream: what waits is state by path, so a restart from the checkpoint loses and repeats nothing.

A request waits until its path has kept still for a while (event time); requests that come meanwhile are merged with it and the
latest decides, as in queue_items(). A timer then hands the item on; time is the requests' own, so the last items of a stream that
falls silent wait for the next request. Each micro-batch of items that are due is given to
``apply`` in the order of drain(); what fails is kept in a table of errors, and the queue goes on."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ITEMS = "file_path string, project_id string, priority double, last_us long, n_requests long"
FAILED = "file_path string, project_id string, error string"
_BURST = "first_us long, last_us long, project_id string, priority double, n_requests long"


class WaitingRequests(StatefulProcessor):
    """The bursts of one path that are still open, each (first, last, project, priority, requests). Rows are merged as they come, so what
    is held grows with the bursts of a path between two watermarks, not with its rows."""

    def __init__(self, wait_us: int):
        self.wait_us = wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bursts = handle.getListState("bursts", _BURST)

    def _due_ms(self, burst: tuple) -> int:
        return -(-(burst[1] + self.wait_us) // 1000)

    def _held(self) -> list[tuple]:
        return sorted((tuple(b) for b in self.bursts.get()), key=lambda b: b[0]) if self.bursts.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held()
        before = min(map(self._due_ms, held), default=None)
        for r in rows:
            merged = (r.first_us, r.last_us, r.project_id, r.priority, r.n_requests)
            at = max(0, bisect_left(held, (r.first_us - self.wait_us,)) - 1)
            while at < len(held) and held[at][0] <= merged[1] + self.wait_us:
                if held[at][1] + self.wait_us >= merged[0]:
                    merged = _merge(held.pop(at), merged)
                else:
                    at += 1
            insort(held, merged, key=lambda b: b[0])
        self._keep(held, before)
        return iter(())

    def _keep(self, held: list[tuple], timer: int | None) -> None:
        """A path has one timer, for the burst that ends first; what a timer costs is the same for one burst and for many."""
        first = min(map(self._due_ms, held), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        self.bursts.put(held) if held else self.bursts.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = self._held()
        self._keep([b for b in held if self._due_ms(b) > now], None)
        for _, last, project, priority, n in (b for b in held if self._due_ms(b) <= now):
            yield Row(file_path=key[0], project_id=project, priority=priority, last_us=last, n_requests=n)

    def close(self) -> None:
        pass


def _merge(a: tuple, b: tuple) -> tuple:
    """One burst of two; the latest request decides, of requests of the same time the one of higher priority, then of the larger project."""
    best = max(a, b, key=lambda x: (x[1], x[3], x[2] or ""))
    return min(a[0], b[0]), best[1], best[2], best[3], a[4] + b[4]


def _combined(wait_us: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a path within a batch become its bursts before anything is shuffled, so a path of very many requests sends few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [(c, "ascending") for c in ("file_path", "ts_us", "priority", "project_id")]
            rows = pa.Table.from_batches([batch]).take(pc.sort_indices(batch, keys, null_placement="at_start"))
            us = rows.column("ts_us").to_numpy()
            code = rows.column("file_path").combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(us) > wait_us)])
            ends = np.r_[starts[1:], len(us)]
            best = rows.take(pa.array(ends - 1))  # the latest, and of these the highest
            yield pa.RecordBatch.from_arrays(
                [best.column("file_path").combine_chunks(), best.column("project_id").combine_chunks(), best.column("priority").combine_chunks(), pa.array(us[starts]), pa.array(us[ends - 1]), pa.array(ends - starts)],
                names=["file_path", "project_id", "priority", "first_us", "last_us", "n_requests"],
            )

    return run


def due_items(requests: DataFrame, wait: str = "500 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """A stream of (file_path, project_id, priority, ts timestamp) as a stream of items that are due: (file_path, project_id, priority,
    ts, n_requests). A request is late, and left out, once the watermark has passed the end of its burst within its batch. A missing priority is the time in seconds, so newer ones come first; rows without a path or a time are no requests.

    Needs the RocksDB state store (start it inside durable_state())."""
    spark = requests.sparkSession
    wait_us = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01T00:00:00Z' + INTERVAL {wait}) AS w").first().w
    ready = requests.where("file_path IS NOT NULL AND ts IS NOT NULL")
    ready = ready.select("file_path", "project_id", F.coalesce(F.col("priority").cast("double"), F.unix_micros("ts") / 1e6).alias("priority"), F.unix_micros("ts").alias("ts_us"))
    merged = ready.mapInArrow(_combined(wait_us), "file_path string, project_id string, priority double, first_us long, last_us long, n_requests long")
    out = merged.withColumn("ts", F.timestamp_micros("last_us")).withWatermark("ts", watermark)
    out = out.groupBy("file_path").transformWithState(WaitingRequests(wait_us), ITEMS, "Append", "EventTime")
    return out.select("file_path", "project_id", "priority", F.timestamp_micros("last_us").alias("ts"), "n_requests")


@contextmanager
def durable_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started meanwhile keep their state, timers included, in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER_KEY) if before is None else spark.conf.set(PROVIDER_KEY, before)


def run_queue(
    requests: DataFrame, apply: Callable[[DataFrame, int], DataFrame | None], errors: str, checkpoint: str, wait: str = "500 milliseconds", watermark: str = "10 seconds", interval: str | None = "1 second"
) -> StreamingQuery:
    """Starts the queue. apply(items, epoch) gets what is due, best first, and returns what failed (FAILED) or nothing.

    Failures of an epoch are written below ``errors`` in a folder of their own, so an epoch that is done again after a crash leaves
    one copy. Where apply raises, the stream ends and a restart does the epoch again. Without interval: what is there, then stop."""

    def step(items: DataFrame, epoch: int) -> None:
        failed = apply(items.orderBy(F.desc("priority"), F.desc("ts"), "file_path"), epoch)
        if failed is not None:
            failed.select("file_path", "project_id", "error").write.mode("overwrite").parquet(f"{errors}/epoch={epoch}")

    writer = due_items(requests, wait, watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(step)
    with durable_state(requests.sparkSession):
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
