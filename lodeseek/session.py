"""Session helpers: building a session, reading tables, cutting lineage in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lodeseek", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that every query here expects; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def share_package(spark: SparkSession) -> None:
    """Lets Python workers that start from now on import this package from where the driver has it, whatever folder
    they start in. Where executors have another file system, the package is installed there or shipped with the job."""
    home = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([home, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt to all of them (a small file often is one row group, so one task would
    do all the work); one of more stays as it is read. Only for scans: others would be run to know their partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and
    driver and executors are one process. Elsewhere each executor would write to its own disk, and reads miss files."""
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that the driver and all executors share (master: {master})")
        root = "file://" + tempfile.mkdtemp(prefix="lodeseek-scratch-")
        spark.conf.set(_CHECKPOINT_KEY, root)
    return root.rstrip("/")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write are deleted at its end, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP_KEY) if before is None else spark.conf.set(_CLEANUP_KEY, before)


def materialize(df: DataFrame, label: str = "step", free_shuffles: bool = False) -> DataFrame:
    """Writes df as Parquet under the shared scratch folder and reads it back: lineage ends there,
    and a lost executor costs no recomputation of what was written. With free_shuffles the shuffle
    files of the write are deleted at its end, not when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lodeseek/{label}-{uuid.uuid4().hex}"
    for made in _collectors:
        made.append(path)
    with freed_shuffles(spark) if free_shuffles else nullcontext():
        # Snappy works in direct buffers that only a heap collection frees, so many small tasks fill memory; zstd does not.
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Lists that collect the paths of tables as they are written.
_collectors: list[list[str]] = []


@contextmanager
def written_tables() -> Iterator[list[str]]:
    """The paths of the tables that materialize() writes meanwhile, to be dropped once nothing lazy reads them."""
    made: list[str] = []
    _collectors.append(made)
    try:
        yield made
    finally:
        _collectors.remove(made)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if "/lodeseek/" in path:
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(conf).delete(path, True)


def drop_materialized(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote and that nothing lazy still reads."""
    drop_paths(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def shuffle_partitions_for(spark: SparkSession, n_bytes: float, target_bytes: int = 32 << 20) -> int:
    """Partitions such that each holds about target_bytes; never fewer than the session's own setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes // target_bytes) + 1)
