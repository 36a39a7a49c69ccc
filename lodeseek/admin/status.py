"""Index status, health and metrics, as small DataFrames."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = "project_id string, root_path string, status string, last_indexed timestamp, total_files long, total_symbols long, total_vectors long"


def project_totals(files: DataFrame) -> DataFrame:
    """files (success, symbols, vectors, error) -> one row of counts, sums and the errors' messages."""
    return files.agg(
        F.count_if("success").alias("indexed_files"), F.count_if(~F.col("success")).alias("failed_files"),
        F.coalesce(F.sum("symbols"), F.lit(0)).alias("total_symbols"), F.coalesce(F.sum("vectors"), F.lit(0)).alias("total_vectors"),
        F.array_sort(F.collect_list("error")).alias("errors"),
    )


def index_size(vectors: Column, symbols: Column, dimension: int = 384) -> Column:
    """Estimated bytes: vectors and their metadata, and symbols."""
    return vectors * dimension * 4 + vectors * 200 + symbols * 100


def upsert_metadata(current: DataFrame, new: DataFrame) -> DataFrame:
    """Newer rows win, but what they leave null stays."""
    names = [c for c in current.columns if c != "project_id"]
    joined = current.alias("o").join(new.alias("n"), "project_id", "full_outer")
    return joined.select("project_id", *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in names))


def status_of(metadata: DataFrame, project: str | None = None) -> DataFrame:
    """All projects or one; a project that is not there is a row of zeros with status 'indexed'."""
    if project is None:
        return metadata
    asked = metadata.sparkSession.createDataFrame([(project,)], "project_id string")
    joined = F.broadcast(asked).join(metadata, "project_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("total_files", "total_symbols", "total_vectors")}
    return joined.select("project_id", "root_path", F.coalesce("status", F.lit("indexed")).alias("status"), "last_indexed", *zeros.values())


def overall_health(store: Column, embedder: Column) -> Column:
    """healthy if both are up, unhealthy if neither is, else degraded."""
    up = (store == "up").cast("int") + (embedder == "up").cast("int")
    return F.when(up == 2, "healthy").when(up == 0, "unhealthy").otherwise("degraded")


def within(action: Callable[[], object], seconds: float) -> object:
    """The action's answer, or TimeoutError once it takes longer; it is then left to end by itself."""
    found: list = []

    def run() -> None:
        try:
            found.append((action(), None))
        except Exception as error:  # noqa: BLE001  raised again below
            found.append((None, error))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not found:
        raise TimeoutError(f"no answer within {seconds:g} s")
    answer, error = found[0]
    if error is not None:
        raise error
    return answer


class HealthChecker:
    """Probes the store and the embedder, each for a few seconds at most; an answer is kept for a while."""

    def __init__(
        self, version: str, store_probe: Callable[[], None] | None = None, embed_probe: Callable[[], list] | None = None, keep_s: float = 30.0, clock=time.monotonic,
        timeout_s: float = 5.0,
    ):
        self.version, self.keep_s, self.timeout_s, self._clock, self._since = version, keep_s, timeout_s, clock, clock()
        self._probes = {"vector_store": store_probe, "embedding_engine": embed_probe}
        self._last: tuple[float, dict] | None = None

    def _probe(self, name: str) -> dict:
        probe = self._probes[name]
        if probe is None:
            return {"status": "unknown"}
        began = self._clock()
        try:
            answer = within(probe, self.timeout_s)
            if name == "embedding_engine" and not answer:
                raise ValueError("empty vector")
        except Exception as error:  # noqa: BLE001  whatever a probe raises is its finding
            if name == "vector_store" and "not exist" in str(error):
                return {"status": "up", "latency_s": self._clock() - began}
            return {"status": "down", "error": str(error)}
        return {"status": "up", "latency_s": self._clock() - began}

    def check(self) -> dict:
        if (kept := self.status()) is not None:
            return kept
        parts = {name: self._probe(name) for name in self._probes}
        up = sum(p["status"] == "up" for p in parts.values())
        found = {"status": ("unhealthy", "degraded", "healthy")[up], "version": self.version, "uptime_s": self._clock() - self._since, "dependencies": parts}
        self._last = (self._clock(), found)
        return found

    def status(self) -> dict | None:
        return self._last[1] if self._last and self._clock() - self._last[0] < self.keep_s else None


def counters(events: DataFrame, key: str) -> DataFrame:
    """(key, requests, errors)."""
    return events.groupBy(key).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))


def latency_histogram(events: DataFrame, key: str, value: str, bounds: tuple[float, ...] = (5, 10, 25, 50, 100, 250, 500, 1000)) -> DataFrame:
    """(key, upper bound or null beyond the last, count)."""
    bound = F.lit(None).cast("double")
    for b in sorted(bounds, reverse=True):
        bound = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(bound)
    return events.groupBy(key, bound.alias("le")).agg(F.count("*").alias("n"))
