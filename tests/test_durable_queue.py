"""The queue as a stream: bursts as by brute force, restarts, errors, order."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodeseek.streaming import changes
from lodeseek.streaming.durable_queue import FAILED, run_queue

SCHEMA = "file_path string, project_id string, priority double, ts timestamp"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(s: float) -> datetime.datetime:
    return START + datetime.timedelta(seconds=s)


class Run:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.order = spark, folder, []
        (folder / "in").mkdir()

    def put(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def go(self, apply=None):
        def note(items, epoch):
            self.order += [(r.file_path, r.project_id, r.priority, r.ts.timestamp(), r.n_requests) for r in items.collect()]

        stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.folder / "in"))
        run_queue(stream, apply or note, str(self.folder / "errors"), str(self.folder / "state"), "5 seconds", "3 seconds", None).awaitTermination()


def bursts(rows, wait, until):
    """Sessions by brute force, of those whose end the watermark has passed."""
    out = []
    for path in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == path), key=lambda r: (r[3], r[2], r[1]))
        run = []
        for r in [*own, None]:
            if run and (r is None or (r[3] - run[-1][3]).total_seconds() > wait):
                if (run[-1][3] - START).total_seconds() + wait <= until:
                    out.append((path, run[-1][1], run[-1][2], run[-1][3].timestamp(), len(run)))
                run = []
            run.append(r)
    return sorted(out)


@pytest.fixture
def run(spark, tmp_path):
    return Run(spark, tmp_path)


def test_bursts_across_restarts(run):
    rng = random.Random(1)
    rows = [(f"p{rng.randint(0, 4)}", f"j{rng.randint(0, 1)}", float(rng.randint(0, 3)), at(round(rng.uniform(0, 120), 3))) for _ in range(150)]
    rows.sort(key=lambda r: r[3])
    for lo in range(0, 150, 50):  # within a batch rows come in any order; each batch is a run of its own
        part = rows[lo : lo + 50]
        rng.shuffle(part)
        run.put(part)
        run.go()
    latest = (rows[-1][3] - START).total_seconds()
    assert sorted(run.order) == bursts(rows, 5, latest - 3)
    before = list(run.order)
    run.go()
    assert run.order == before  # nothing is handed on twice


def test_order_and_missing_values(run):
    run.put([("a", "p", 1.0, at(0)), ("b", "p", None, at(1)), ("c", "p", 9.0, at(1)), ("d", None, 9.0, at(2)), ("a", "q", 9.0, at(2)), (None, "p", 1.0, at(0)), ("x", "p", 1.0, None), ("end", "p", 0.0, at(100))])
    run.go()
    items = run.spark.createDataFrame([("b", START.timestamp() + 1, at(1)), ("c", 9.0, at(1)), ("d", 9.0, at(2)), ("a", 9.0, at(2))], "file_path string, priority double, ts timestamp")
    assert [x[0] for x in run.order] == [r.file_path for r in changes.drain(items, 10).collect()] == ["b", "a", "d", "c"]
    assert [x[4] for x in run.order] == [1, 2, 1, 1] and run.order[1][1] == "q"


def test_failures_are_kept_and_an_epoch_that_dies_is_done_again(run):
    run.put([("a", "p", 1.0, at(0)), ("b", "p", 2.0, at(0)), ("end", "p", 0.0, at(100))])
    seen = []

    def dies(items, epoch):
        seen.append(sorted(r.file_path for r in items.collect()))
        if seen[-1]:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run.go(dies)
    run.go(lambda items, epoch: items.where("file_path = 'b'").select("file_path", "project_id", F.lit("cannot read").alias("error")))
    errors = run.spark.read.schema(FAILED).parquet(str(run.folder / "errors")).collect()
    assert [(r.file_path, r.error) for r in errors] == [("b", "cannot read")] and seen[-1] == ["a", "b"]


def test_empty_stream(run):
    run.put([])
    run.go()
    assert run.order == []
