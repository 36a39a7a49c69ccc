"""Changes of a source tree as a streaming source: ``spark.readStream.format("lodeseek_tree")``.

Stores send no notices, so the source lists the tree when Spark asks for the latest offset. A listing that differs from the last
one is kept as a snapshot and gets the next version; offsets are versions. A batch compares the snapshots of its two versions,
bucket by bucket in tasks, so a batch that is done again after a crash has the same rows, and a restart from a checkpoint reports
what changed while nothing ran. A file that was written to in the last ``stable_s`` seconds waits for a later listing.

Rows: event (added, changed, deleted), path (relative), size and modified (milliseconds; null where deleted), ts (of the listing).
Options: path and state are URIs as Hadoop has them (watch_tree() makes them), ignores a JSON list of patterns."""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodeseek.sources import ignore
from lodeseek.sources.scan import located
from lodeseek.sources.tree import open_store
from lodeseek.streaming.changes import WATCH_IGNORES

SCHEMA = "event string, path string, size long, modified long, ts timestamp"
_BATCH = pa.schema([("event", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), ("ts", pa.timestamp("us", "UTC"))])
_SNAPSHOT = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64())])


@dataclass
class Bucket(InputPartition):
    before: int
    after: int
    bucket: int


class Snapshots:
    """Listings by version, one row group a bucket of paths; version 0 is the empty tree."""

    def __init__(self, state: str, buckets: int):
        self.store, place = open_store(state)
        self.folder, self.buckets = place(state).rstrip("/"), buckets
        self.store.create_dir(self.folder, recursive=True)

    def versions(self) -> list[int]:
        names = (f.base_name for f in self.store.get_file_info(afs.FileSelector(self.folder)))
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".parquet"))

    def _file(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.parquet"

    def write(self, version: int, found: dict[str, tuple[int, int]], ts_ms: int) -> None:
        """Whole or not at all: the file gets its name once it is written."""
        draft = f"{self.folder}/{version:012d}.draft"
        rows: list[list[tuple[str, int, int]]] = [[] for _ in range(self.buckets)]
        for path, (size, modified) in sorted(found.items()):
            rows[zlib.crc32(path.encode("utf-8", "surrogatepass")) % self.buckets].append((path, size, modified))
        with self.store.open_output_stream(draft) as out, pq.ParquetWriter(out, _SNAPSHOT.with_metadata({"ts_ms": str(ts_ms), "buckets": str(self.buckets)})) as writer:
            for own in rows:
                columns = list(zip(*own)) or [(), (), ()]
                writer.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _SNAPSHOT.types)], schema=_SNAPSHOT), row_group_size=max(1, len(own)))
        self.store.move(draft, self._file(version))

    def read(self, version: int, bucket: int | None = None) -> tuple[dict[str, tuple[int, int]], int]:
        """({path: (size, modified)}, time of the listing), of one bucket or of all."""
        if version == 0:
            return {}, 0
        with self.store.open_input_file(self._file(version)) as source:
            file = pq.ParquetFile(source)
            kept = file.schema_arrow.metadata
            if int(kept[b"buckets"]) == self.buckets and file.num_row_groups == self.buckets:
                rows = (file.read() if bucket is None else file.read_row_group(bucket)).to_pylist()
            else:  # empty buckets have no row group, or the number of buckets was another when it was written
                rows = file.read().to_pylist()
                if bucket is not None:
                    rows = [r for r in rows if zlib.crc32(r["path"].encode("utf-8", "surrogatepass")) % self.buckets == bucket]
        return {r["path"]: (r["size"], r["modified"]) for r in rows}, int(kept[b"ts_ms"])

    def drop_before(self, version: int) -> None:
        for old in self.versions():
            if old < version:
                self.store.delete_file(self._file(old))


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.home, self.state = self.options["path"].rstrip("/"), self.options["state"]
        self.buckets = int(self.options.get("buckets", "8"))
        self.stable_ms = int(1000 * float(self.options.get("stable_s", "0.1")))

    def _listed(self) -> Iterator[tuple[str, int, int]]:
        store, place = open_store(self.home)
        ignores = json.loads(self.options.get("ignores", json.dumps(WATCH_IGNORES)))
        excluded, pruned = ignore.matcher(ignores, defaults=()), ignore.pruner(ignores, defaults=())
        waiting = [""]
        while waiting:
            folder = waiting.pop()
            try:
                found = store.get_file_info(afs.FileSelector(place(f"{self.home}/{folder}" if folder else self.home)))
            except FileNotFoundError:
                if not folder:
                    raise
                continue  # it went while the tree was listed
            for entry in found:
                rel = f"{folder}/{entry.base_name}" if folder else entry.base_name
                if entry.type == afs.FileType.Directory:
                    waiting += [] if pruned(rel) else [rel]
                elif not excluded(rel):
                    yield rel, entry.size or 0, (entry.mtime_ns or 0) // 1_000_000

    def _newest(self) -> int:
        """The version of the tree as it is now: a new one where it differs from the last."""
        snapshots, now = Snapshots(self.state, self.buckets), int(1000 * time.time())
        last = max(snapshots.versions(), default=0)
        before, _ = snapshots.read(last)
        found = {}
        for rel, size, modified in self._listed():
            if 0 <= now - modified < self.stable_ms and before.get(rel) != (size, modified):
                if rel in before:
                    found[rel] = before[rel]
            else:
                found[rel] = (size, modified)
        if found == before:
            return last
        snapshots.write(last + 1, found, now)
        return last + 1

    def initialOffset(self) -> dict:
        return {"version": self._newest() if self.options.get("ignore_initial", "true") == "true" else 0}

    def latestOffset(self) -> dict:
        return {"version": self._newest()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Bucket(start["version"], end["version"], i) for i in range(self.buckets)] if start != end else []

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        snapshots = Snapshots(self.state, self.buckets)
        before, _ = snapshots.read(partition.before, partition.bucket)
        after, ts = snapshots.read(partition.after, partition.bucket)
        rows = [("deleted", p, None, None) for p in before.keys() - after.keys()]
        rows += [("added" if p not in before else "changed", p, *a) for p, a in after.items() if before.get(p) != a]
        if rows:
            columns = list(zip(*sorted(rows, key=lambda r: r[1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, [1000 * ts] * len(rows)], _BATCH.types)], schema=_BATCH)

    def commit(self, end: dict) -> None:
        Snapshots(self.state, self.buckets).drop_before(end["version"])

    def stop(self) -> None:
        pass


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodeseek_tree"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeReader(dict(self.options))


def watch_tree(spark: SparkSession, root: str, state: str, ignores: Sequence[str] = WATCH_IGNORES, stable_s: float = 0.1, ignore_initial: bool = True, buckets: int = 8) -> DataFrame:
    """The stream of changes of a tree. ``state`` is a folder of this stream's own, shared by driver and executors like its checkpoint;
    with ignore_initial what is there at the stream's first start is no change. A missing root raises."""
    spark.dataSource.register(TreeChanges)
    options = {"path": located(spark, root), "state": state, "ignores": json.dumps(list(ignores)), "stable_s": str(stable_s)}
    return spark.readStream.format(TreeChanges.name()).options(**options, ignore_initial=str(ignore_initial).lower(), buckets=str(buckets)).load()
