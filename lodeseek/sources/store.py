"""A versioned table store: each write makes new folders, and one manifest then names the versions of all tables.

A transaction publishes the changes of several tables by one new manifest: readers see all of them or none. It fails if
another writer has published one since it began, so no change is lost; the caller does it again on what is there now. A
single write is a transaction of its own. A version is a list of parts, oldest first; a part holds rows, and keys whose
rows in older parts are gone. So a small change writes what changed, not the table; after some changes the parts are
merged. Readers that opened a version keep it while the newest ``keep`` versions include it. Manifests and folders live
wherever Spark's Hadoop file systems reach, so nothing here opens a local path."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeseek.operators import bm25

#: After so many changes a table's parts are merged.
MAX_PARTS = 12

#: Columns that reading adds and drops: the part of a row, and the last part in which its key is gone.
_PART, _GONE = "_lodeseek_part", "_lodeseek_gone"


class Conflict(RuntimeError):
    """Another writer published a manifest since this transaction began."""


@dataclass
class Store:
    spark: SparkSession
    root: str
    keep: int = 3  # versions that stay readable
    _own: threading.local = field(default_factory=threading.local, repr=False)  # the transaction of each thread
    _schemas: dict[str, dict] = field(default_factory=dict, repr=False)  # of folders that were written and are not published

    def _path(self, text: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(n for s in fs.listStatus(path) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(path) else []

    def _read_json(self, text: str):
        path, fs = self._path(text)
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_json(self, text: str, value) -> bool:
        """Whole or not at all; False if the file is there already."""
        path, fs = self._path(text)
        if fs.exists(path):
            return False
        draft = path.getParent().suffix(f"/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if not fs.exists(path) and fs.rename(draft, path):
            return True
        fs.delete(draft, False)
        return False

    # Manifests: {table: version}

    def _newest_manifest(self) -> tuple[int, dict[str, str]]:
        while True:
            names = self._names(f"{self.root}/_manifests")
            try:
                return (int(names[-1]), self._read_json(f"{self.root}/_manifests/{names[-1]}")) if names else (0, {})
            except Exception:  # a writer removed old manifests between the listing and the reading
                if self._names(f"{self.root}/_manifests") == names:
                    raise

    @property
    def _open(self) -> dict | None:
        return getattr(self._own, "open", None)

    def _tables(self) -> dict[str, str]:
        return self._newest_manifest()[1] if self._open is None else self._open["tables"]

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Changes that are published together at the end, or not at all where anything fails. Inside, reads see them, and other
        tables as they were at its begin. A transaction inside another is part of it."""
        if self._open is not None:
            yield
            return
        number, tables = self._newest_manifest()
        self._own.open = {"tables": dict(tables), "changed": set()}
        try:
            yield
            tables, changed = self._open["tables"], self._open["changed"]
        finally:
            self._own.open = None
        if not changed:
            return
        if not self._write_json(f"{self.root}/_manifests/{number + 1:012d}", tables):
            raise Conflict(f"manifest {number + 1} was published by another writer")
        for old in self._names(f"{self.root}/_manifests")[: -self.keep]:
            path, fs = self._path(f"{self.root}/_manifests/{old}")
            fs.delete(path, False)
        for name in changed:
            if name in tables:
                self.vacuum(name, self.keep)
            else:
                path, fs = self._path(f"{self.root}/{name}")
                fs.delete(path, True)

    def _publish(self, name: str, parts: list[dict]) -> None:
        with self.transaction():
            tables = self._open["tables"]
            number = int(tables[name].split("-")[0]) + 1 if name in tables else 1
            version = f"{number:012d}-{uuid.uuid4().hex}"
            for part in parts:
                known = {part[k]: self._schemas.pop(part[k]) for k in ("rows", "gone") if part.get(k) in self._schemas}
                part["schemas"] = part.get("schemas", {}) | known
            self._write_json(f"{self.root}/{name}/_versions/{version}", parts)
            tables[name] = version
            self._open["changed"].add(name)

    def _parts(self, name: str, version: str) -> list[dict]:
        return self._read_json(f"{self.root}/{name}/_versions/{version}")

    def exists(self, name: str) -> bool:
        return name in self._tables()

    def read(self, name: str) -> DataFrame:
        tables = self._tables()
        if name not in tables:
            raise KeyError(f"no table {name}")
        return self._rows_of(name, self._parts(name, tables[name]))

    def _load(self, name: str, part: dict, kind: str) -> DataFrame:
        """Schemas are kept with the parts, so no job has to find out what a part's files hold."""
        schema = part.get("schemas", {}).get(part[kind])
        reader = self.spark.read.schema(StructType.fromJson(schema)) if schema else self.spark.read
        return reader.parquet(f"{self.root}/{name}/{part[kind]}")

    def _rows_of(self, name: str, parts: list[dict]) -> DataFrame:
        """A row lives if its key is gone in no later part: one anti-join for each key that parts were changed by, however many
        parts there are."""
        rows, gone = None, {}
        for at, part in enumerate(parts):
            if part.get("rows"):
                own = self._load(name, part, "rows")
                own = own.select(*(own.columns if rows is None else rows.columns[:-1]), F.lit(at).alias(_PART))
                rows = own if rows is None else rows.unionByName(own)
            if part.get("gone") and at:
                own = self._load(name, part, "gone").select(*part["key"], F.lit(at).alias(_GONE))
                key = tuple(part["key"])
                gone[key] = gone[key].unionByName(own) if key in gone else own
        for key, keys in gone.items():
            last = keys.groupBy(*key).agg(F.max(_GONE).alias(_GONE)).select(*(F.col(c).alias(f"{_GONE}_{c}") for c in key), _GONE)
            same = [F.col(c) == F.col(f"{_GONE}_{c}") for c in key]
            rows = rows.join(last, reduce(and_, same, F.col(_PART) < F.col(_GONE)), "left_anti")
        return rows.drop(_PART)

    def _bytes(self, name: str, folder: str) -> int:
        path, fs = self._path(f"{self.root}/{name}/{folder}")
        return fs.getContentSummary(path).getLength()

    def _write_folder(self, name: str, df: DataFrame, sort_by: str | Sequence[str] | None = None, partition_by: str | None = None, as_is: bool = False) -> str:
        folder = uuid.uuid4().hex
        self._schemas[folder] = json.loads(df.schema.json())
        if as_is:
            writer = df.write.partitionBy(partition_by) if partition_by else df.write
            writer.parquet(f"{self.root}/{name}/{folder}")
            return folder
        sort_by = [sort_by] if isinstance(sort_by, str) else list(sort_by or ())
        out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
        if partition_by:  # by range: a value of many rows is dealt to several files, one of few to one
            out = df.repartitionByRange(F.col(partition_by), *(sort_by or [F.rand(1)]))
            out = out.sortWithinPartitions(partition_by, *sort_by) if sort_by else out
            out.write.partitionBy(partition_by).parquet(f"{self.root}/{name}/{folder}")
        else:
            out.write.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def write(self, name: str, df: DataFrame, sort_by: str | Sequence[str] | None = None, partition_by: str | None = None, as_is: bool = False) -> None:
        """The whole table, as_is where df is laid out already; else sorted inside files by sort_by, so that row groups can be skipped on it, or with a folder for each value of
        partition_by, so that folders can."""
        self._publish(name, [{"rows": self._write_folder(name, df, sort_by, partition_by, as_is), "sort": sort_by, "partition": partition_by}])

    def change(self, name: str, rows: DataFrame | None, gone: DataFrame | None, key: Sequence[str], sort_by: str | None = None, as_is: bool = False) -> None:
        """Rows whose key is in gone go, then rows come: what is written is as large as the change."""
        with self.transaction():
            parts = self._parts(name, self._tables()[name])
            part: dict = {"key": list(key)}
            by = parts[0].get("partition")
            if gone is not None:
                part["gone"] = self._write_folder(name, gone.select(*key).distinct())
            if rows is not None:
                part["rows"] = self._write_folder(name, rows, partition_by=by, as_is=as_is)
            self._publish(name, [*parts, part])
            if len(parts) >= MAX_PARTS:
                self._merge(name, [*parts, part], sort_by or parts[0].get("sort"), by)

    def _merge(self, name: str, parts: list[dict], sort_by: str | Sequence[str] | None, partition_by: str | None) -> None:
        """The changes become one part, so that merging costs what has changed; the whole table is written anew once they are half
        as large as what they change, or where their keys differ."""
        keys = {tuple(p["key"]) for p in parts[1:]}
        changed = sum(self._bytes(name, p[k]) for p in parts[1:] for k in ("rows", "gone") if p.get(k))
        if len(keys) > 1 or not parts[0].get("rows") or 2 * changed > self._bytes(name, parts[0]["rows"]):
            return self.write(name, self._rows_of(name, parts), sort_by, partition_by)
        one: dict = {"key": list(keys.pop())}
        gone = [self._load(name, p, "gone") for p in parts[1:] if p.get("gone")]
        if gone:
            one["gone"] = self._write_folder(name, reduce(DataFrame.unionByName, gone).distinct())
        if any(p.get("rows") for p in parts[1:]):
            one["rows"] = self._write_folder(name, self._rows_of(name, parts[1:]), sort_by, partition_by)
        self._publish(name, [parts[0], one])

    def drop(self, name: str) -> None:
        """Nothing happens if there is no such table."""
        with self.transaction():
            if self._open["tables"].pop(name, None) is not None:
                self._open["changed"].add(name)

    def vacuum(self, name: str, keep: int = 1) -> None:
        """Removes the published versions but the newest ones, versions of transactions that failed before these, and folders that
        none of the rest uses. Versions after the published one belong to transactions that are open."""
        versions, now = self._names(f"{self.root}/{name}/_versions"), self._tables()[name]
        at = versions.index(now) if now in versions else -1
        stale = versions[: max(0, at + 1 - keep)]
        folders = lambda version: {p[k] for p in self._parts(name, version) for k in ("rows", "gone") if p.get(k)}
        used = set().union(*map(folders, versions[len(stale) :])) if stale else set()
        for version in stale:
            for folder in folders(version) - used:
                path, fs = self._path(f"{self.root}/{name}/{folder}")
                fs.delete(path, True)
            path, fs = self._path(f"{self.root}/{name}/_versions/{version}")
            fs.delete(path, False)

    # Collections of vectors

    def create_collection(self, name: str, schema: str) -> None:
        if self.exists(name):
            raise ValueError(f"collection {name} exists")
        self.write(name, self.spark.createDataFrame([], schema))

    def upsert(self, name: str, rows: DataFrame, id_col: str = "id") -> None:
        """New rows in place of those of the same id."""
        self.change(name, rows, rows.select(id_col), [id_col])

    def delete(self, name: str, ids: DataFrame, id_col: str = "id") -> None:
        self.change(name, None, ids, [id_col])

    # The keyword index

    def write_keyword_index(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        with self.transaction():
            self.write("postings", bm25.postings(docs, id_col, text_col, with_positions=True), sort_by="term")
            self.write("doc_stats", bm25.doc_stats(docs, id_col, text_col))

    def replace_documents(self, docs: DataFrame, gone: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        """docs in place of their old entries, and of those of the ids (doc_id) that are gone."""
        ids = docs.select(F.col(id_col).alias("doc_id"))
        ids = ids if gone is None else ids.union(gone.select("doc_id"))
        with self.transaction():
            self.change("postings", bm25.postings(docs, id_col, text_col, with_positions=True), ids, ["doc_id"])
            self.change("doc_stats", bm25.doc_stats(docs, id_col, text_col), ids, ["doc_id"])

    def delete_documents(self, ids: DataFrame) -> None:
        """ids (doc_id); those that are not there change nothing."""
        with self.transaction():
            for name in ("postings", "doc_stats"):
                self.change(name, None, ids, ["doc_id"])
