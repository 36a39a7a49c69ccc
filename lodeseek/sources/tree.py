"""Listing and reading a source tree in tasks, for trees whose names do not fit the driver.

The frontier of folders is a table. Each level of the tree is one job: tasks list the folders that they were dealt, decide
what is kept and which folders are entered, and write what they found; the folders to enter are the next frontier. Contents
are read in tasks as well, names that begin with a dot or an underscore included. The driver holds a count for each level.
A folder's own names are listed by one task, since stores list a folder by one request after another.

Tasks have no JVM, so they reach the store by Arrow's file systems; scan() in scan.py serves the stores that these lack."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.session import materialize, shuffle_partitions_for
from lodeseek.sources import ignore, languages
from lodeseek.sources.scan import ScanOptions, as_scanned, ignore_layers, located, scan

ENTRIES = "path string, rel_path string, is_dir boolean, size long, modified long, enter boolean, kept boolean, readable boolean"
_ENTRIES = pa.schema(
    [("path", pa.string()), ("rel_path", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("modified", pa.int64()), ("enter", pa.bool_()), ("kept", pa.bool_()), ("readable", pa.bool_())]
)
CONTENTS = "path string, rel_path string, length long, modified long, content binary"
_CONTENTS = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("content", pa.binary())])

#: Schemes of Hadoop's that Arrow has a file system for, under its own names.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}
#: Entries and bytes of contents that a task holds at a time (one file may be larger).
BATCH_ROWS, BATCH_BYTES = 10_000, 32 << 20


def scheme_of(uri: str) -> str:
    return uri.split(":", 1)[0] if ":" in uri.split("/", 1)[0] else "file"


def open_store(home: str) -> tuple[afs.FileSystem, Callable[[str], str]]:
    """The file system of a Hadoop URI, and what turns a URI below it into a path there. Names may hold any character, so only the
    scheme and the authority are parsed as a URI."""
    scheme = scheme_of(home)
    if scheme == "file":
        return afs.LocalFileSystem(), lambda uri: "/" + uri.removeprefix("file:").lstrip("/")
    authority = home.split("://", 1)[1].split("/", 1)[0]
    store, base = afs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{authority}/")
    return store, lambda uri: base.rstrip("/") + "/" + uri.split("://", 1)[1].partition("/")[2]


def _list_folders(home: str, layers: list[list[str]], options: ScanOptions) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    defaults = ignore.DEFAULT_EXCLUSIONS if options.use_defaults else ()
    wanted = list(options.extensions) if options.extensions is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(home)
        excluded, pruned = ignore.matcher(*layers, defaults=defaults), ignore.pruner(*layers, defaults=defaults)
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.column("rel_path").to_pylist():
                uri = f"{home}/{folder}" if folder else home
                try:
                    found = store.get_file_info(afs.FileSelector(place(uri)))
                except OSError:  # as in scan(): the rest of the tree is listed; the root itself must be readable
                    if not folder:
                        raise
                    rows.append((uri, folder, True, 0, 0, False, False, False))
                    continue
                for entry in found:
                    rel = f"{folder}/{entry.base_name}" if folder else entry.base_name
                    is_dir = entry.type == afs.FileType.Directory
                    kept = not is_dir and languages.is_scanned_path(rel, wanted) and not excluded(rel)
                    rows.append((f"{home}/{rel}", rel, is_dir, entry.size or 0, (entry.mtime_ns or 0) // 1_000_000, is_dir and not pruned(rel), kept, True))
                    if len(rows) >= BATCH_ROWS:
                        yield _batch(rows, _ENTRIES)
                        rows = []
        if rows:
            yield _batch(rows, _ENTRIES)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)], schema=schema)


def list_tree(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """ENTRIES of all files and folders that were seen: kept files are to be indexed, folders with enter were listed in turn, and
    those that could not be listed come once more with readable false. A missing root raises."""
    home = located(spark, root)
    work = _list_folders(home, [list(options.exclude), *ignore_layers(spark, root, options.ignore_files)], options)
    most = 4 * spark.sparkContext.defaultParallelism
    frontier, folders, levels = spark.range(1).select(F.lit("").alias("rel_path")), 1, []
    while folders:
        dealt = frontier.repartition(min(folders, most), "rel_path")
        levels.append(materialize(dealt.mapInArrow(work, ENTRIES), "tree-level"))
        frontier = levels[-1].where("enter").select("rel_path")
        folders = frontier.count()
    return reduce(DataFrame.union, levels)


def read_tree(files: DataFrame, home: str) -> DataFrame:
    """CONTENTS of listed files. A file that went since it was listed has no row."""
    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(home)
        rows, held = [], 0
        for batch in batches:
            for path, rel, modified in zip(*(batch.column(c).to_pylist() for c in ("path", "rel_path", "modified"))):
                try:
                    with store.open_input_stream(place(path)) as stream:
                        content = stream.read()
                except FileNotFoundError:
                    continue
                rows.append((path, rel, len(content), modified, content))
                held += len(content)
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows, _CONTENTS)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _CONTENTS)

    dealt = files.select("path", "rel_path", "modified").repartition(shuffle_partitions_for(spark, total))
    return dealt.mapInArrow(run, CONTENTS)


def scan_tree(spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), project: str = "default") -> DataFrame:
    """The rows of scan(), listed and read in tasks; by scan() itself where Arrow has no file system for the root's scheme."""
    home = located(spark, root)
    if scheme_of(home) not in SCHEMES:
        return scan(spark, root, options, project)
    files = read_tree(list_tree(spark, root, options).where("kept"), home)
    return as_scanned(files.withColumn("modificationTime", F.timestamp_millis("modified")), project)


def tree_stats(entries: DataFrame) -> DataFrame:
    """(total_files, excluded_files, unreadable_folders) of list_tree()."""
    return entries.agg(
        F.count_if("kept").alias("total_files"), F.count_if(F.expr("NOT is_dir AND NOT kept")).alias("excluded_files"), F.count_if(F.expr("NOT readable")).alias("unreadable_folders")
    )
