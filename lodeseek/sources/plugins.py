"""Vector store plugins: what one must offer, a registry of them by name, and the Parquet store as one."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession

from lodeseek.admin.errors import ConfigInvalid
from lodeseek.operators import vectors
from lodeseek.sources.store import Store

T = TypeVar("T")


class VectorStore(Protocol):
    """Names are unique. Every call but connect() raises before connect(); calls on a missing collection raise KeyError,
    except that dropping one does nothing."""

    name: str

    def connect(self, config: Mapping) -> None: ...
    def disconnect(self) -> None: ...
    def create_collection(self, name: str, dimension: int) -> None: ...
    def delete_collection(self, name: str) -> None: ...
    def upsert(self, collection: str, rows: DataFrame) -> None: ...
    def query(self, collection: str, vector: Sequence[float], k: int, where: Mapping[str, object] | None = None) -> DataFrame: ...
    def delete(self, collection: str, ids: Sequence[str]) -> None: ...
    def stats(self, collection: str) -> dict: ...


class Registry:
    """Plugins in the order in which they were registered."""

    def __init__(self) -> None:
        self._plugins: dict[str, VectorStore] = {}

    def register(self, plugin: VectorStore) -> None:
        if plugin.name in self._plugins:
            raise ValueError(f"a plugin {plugin.name} is registered already")
        self._plugins[plugin.name] = plugin

    def get(self, name: str) -> VectorStore:
        if name not in self._plugins:
            raise KeyError(f"no plugin {name}")
        return self._plugins[name]

    def has(self, name: str) -> bool:
        return name in self._plugins

    def unregister(self, name: str) -> None:
        self._plugins.pop(name, None)

    def list(self) -> list[str]:
        return list(self._plugins)


@dataclass(frozen=True)
class Backoff:
    """Waits between tries; each is a multiple of the one before, up to a limit."""

    retries: int = 3
    first_s: float = 1.0
    factor: float = 2.0
    longest_s: float = 10.0

    def waits(self) -> list[float]:
        return [min(self.longest_s, self.first_s * self.factor**i) for i in range(self.retries)]


def with_retry(action: Callable[[], T], what: str, backoff: Backoff = Backoff(), sleep: Callable[[float], None] = time.sleep) -> T:
    """The action's value; its last error, with the number of tries, once all have failed."""
    waits = backoff.waits()
    for wait in [*waits, None]:
        try:
            return action()
        except Exception as error:  # noqa: BLE001  whatever a store raises is tried again
            if wait is None:
                raise ConnectionError(f"{what} failed {len(waits) + 1} times: {error}") from error
            sleep(wait)
    raise AssertionError


class ParquetVectors:
    """Collections (id, vector, and metadata as columns) in the snapshot store."""

    def __init__(self, spark: SparkSession, name: str = "parquet", backoff: Backoff = Backoff(), sleep: Callable[[float], None] = time.sleep):
        self.name, self._spark, self._backoff, self._sleep = name, spark, backoff, sleep
        self._store: Store | None = None

    def connect(self, config: Mapping) -> None:
        """config: {"config": {"path": folder}}; the folder is made if it is missing."""
        root = (config.get("config") or {}).get("path")
        if not root:
            raise ConfigInvalid("vectorStore.config.path is required")

        def reach() -> Store:
            path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
            return Store(self._spark, root)

        self._store = with_retry(reach, "connect", self._backoff, self._sleep)

    def disconnect(self) -> None:
        self._store = None

    @property
    def store(self) -> Store:
        if self._store is None:
            raise ConnectionError("not connected; call connect() first")
        return self._store

    def create_collection(self, name: str, dimension: int, metadata: str = "project_id string, file_path string, name string, type string, language string") -> None:
        if dimension < 1:
            raise ValueError("the dimension must be at least 1")
        self.store.create_collection(name, f"id string, vector array<double>, dimension int{', ' + metadata if metadata else ''}")

    def delete_collection(self, name: str) -> None:
        self.store.drop(name)

    def upsert(self, collection: str, rows: DataFrame) -> None:
        old = self.store.read(collection)
        missing = [c for c in old.columns if c not in rows.columns]
        from pyspark.sql import functions as F

        known = {f.name: f.dataType for f in old.schema}
        fill = {"dimension": F.size("vector")} | {c: F.lit(None).cast(known[c]) for c in missing if c != "dimension"}
        self.store.upsert(collection, rows.withColumns({c: fill[c] for c in missing}).select(*(F.col(c).cast(known[c]).alias(c) for c in old.columns)))

    def query(self, collection: str, vector: Sequence[float], k: int, where: Mapping[str, object] | None = None) -> DataFrame:
        from pyspark.sql import functions as F

        rows = self.store.read(collection)
        for column, value in (where or {}).items():
            rows = rows.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
        return vectors.top_k(rows, list(vector), k, id_col="id", vector_col="vector")

    def delete(self, collection: str, ids: Sequence[str]) -> None:
        self.store.delete(collection, self._spark.createDataFrame([(i,) for i in ids], "id string"))

    def stats(self, collection: str) -> dict:
        from pyspark.sql import functions as F

        row = self.store.read(collection).agg(F.count("*").alias("n"), F.max("dimension").alias("d")).first()
        return {"vectorCount": row.n, "dimension": row.d or 0, "indexSize": row.n * (row.d or 0) * 4}


def default_registry(spark: SparkSession) -> Registry:
    out = Registry()
    out.register(ParquetVectors(spark))
    return out


def make_store(config: Mapping, registry: Registry) -> VectorStore:
    """The store that a configuration names, connected."""
    section = config["vectorStore"]
    if not registry.has(section["backend"]):
        raise ConfigInvalid(f"no plugin for the backend {section['backend']}; registered: {', '.join(registry.list()) or 'none'}")
    plugin = registry.get(section["backend"])
    plugin.connect(section)
    return plugin
