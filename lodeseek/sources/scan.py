"""Reading a source tree through Hadoop's file systems, so any store that Spark reads will do.

A tree is listed first, by name alone: excluded folders are not entered, and contents are read only of files that are
kept. Spark's file sources leave out names that begin with a dot or an underscore (``__init__.py`` among them), so
these files are opened through the same file system; all others are read by Spark's tasks."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.sources import ignore, languages

FILES = "path string, length long, modificationTime timestamp, content binary"


@dataclass(frozen=True)
class ScanOptions:
    extensions: Sequence[str] | None = None
    exclude: Sequence[str] = ()
    use_defaults: bool = True
    ignore_files: Sequence[str] = field(default=(".gitignore", ".mcpignore"))
    max_hidden_bytes: int = 256 << 20  # of files that Spark's sources leave out


@dataclass
class Listing:
    """Kept files as (path, relative path, size, milliseconds) and how the listing went."""

    files: list[tuple[str, str, int, int]]
    total_files: int
    excluded_files: int
    seconds: float
    unreadable: list[str]


def relative(path: Column, root: str) -> Column:
    """Path below the root, whatever scheme the store has."""
    plain = root.split(":", 1)[-1].rstrip("/") if ":" in root else root.rstrip("/")
    plain = "/" + plain.lstrip("/")
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9+.-]+:/+", "/"), f"^.*?\\Q{plain}/\\E", "")


def _open(spark: SparkSession, *parts: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(*parts)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def located(spark: SparkSession, root: str) -> str:
    """The root's full URI, without a slash at its end; a missing root raises."""
    path, fs = _open(spark, root)
    return fs.getFileStatus(path).getPath().toString().rstrip("/")


def _bytes(spark: SparkSession, path, fs) -> bytes:
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "ISO-8859-1").encode("latin-1")
    finally:
        stream.close()


def ignore_layers(spark: SparkSession, root: str, names: Sequence[str]) -> list[list[str]]:
    """The patterns of the ignore files right below the root; those that are not there have none."""
    out = []
    for name in names:
        path, fs = _open(spark, root, name)
        if fs.exists(path):
            out.append(ignore.parse(_bytes(spark, path, fs).decode("utf-8", "replace")))
    return out


_STATUS = re.compile(r"isDirectory=(true|false);(?: length=(\d+);)?.*?modification_time=(\d+)", re.DOTALL)


def walk(spark: SparkSession, root: str, enter: Callable[[str], bool], unreadable: list[str]) -> Iterator[tuple[str, str, bool, int, int]]:
    """(path, relative path, whether it is a folder, size, milliseconds), hidden names included, depth first. A folder is listed if
    enter(its relative path); one that cannot be read is noted. A missing root raises."""
    base, fs = _open(spark, root)
    status = fs.getFileStatus(base)
    home = status.getPath().toString().rstrip("/") + "/"
    waiting = [status.getPath()]
    while waiting:
        folder = waiting.pop()
        try:
            found = list(fs.listStatus(folder))
        except Exception:  # noqa: BLE001  whatever the store raises, the rest of the tree is listed
            if folder.toString().rstrip("/") + "/" == home:
                raise
            unreadable.append(folder.toString())
            continue
        below = []
        for entry in found:
            path = entry.getPath()
            text = path.toString()
            is_dir, size, modified = _STATUS.search(entry.toString()[len(text) :]).groups()
            rel = text.removeprefix(home)
            yield text, rel, is_dir == "true", int(size or 0), int(modified)
            if is_dir == "true" and enter(rel):
                below.append((text, path))
        waiting += [p for _, p in sorted(below, reverse=True, key=lambda x: x[0])]


def list_one(spark: SparkSession, path: str) -> tuple[str, str, int, int] | None:
    """(path, name, size, milliseconds) of one file, as list_files() lists it; None if there is none."""
    handle, fs = _open(spark, path)
    if not fs.exists(handle):
        return None
    entry = fs.getFileStatus(handle)
    if entry.isDirectory():
        return None
    text = entry.getPath().toString()
    return text, text.rpartition("/")[2], entry.getLen(), entry.getModificationTime()


def list_files(spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), on_event: Callable[[str, str], None] | None = None) -> Listing:
    """The files to index. on_event gets (event, relative path): directoryEntered, fileFound for each file, fileScanned
    for each that is kept, and scanComplete at the end."""
    began, tell = time.monotonic(), on_event or (lambda event, path: None)
    layers = [list(options.exclude), *ignore_layers(spark, root, options.ignore_files)]
    defaults = ignore.DEFAULT_EXCLUSIONS if options.use_defaults else ()
    excluded, pruned = ignore.matcher(*layers, defaults=defaults), ignore.pruner(*layers, defaults=defaults)
    wanted = list(options.extensions) if options.extensions is not None else None
    out = Listing([], 0, 0, 0.0, [])
    tell("directoryEntered", "")

    def enter(rel: str) -> bool:
        if pruned(rel):
            return False
        tell("directoryEntered", rel)
        return True

    for path, rel, is_dir, size, modified in walk(spark, root, enter, out.unreadable):
        if is_dir:
            continue
        tell("fileFound", rel)
        if languages.is_scanned_path(rel, wanted) and not excluded(rel):
            out.files.append((path, rel, size, modified))
            out.total_files += 1
            tell("fileScanned", rel)
        else:
            out.excluded_files += 1
    out.seconds = time.monotonic() - began
    tell("scanComplete", "")
    return out


def is_hidden(rel: str) -> bool:
    """Whether Spark's file sources leave the file out."""
    return rel.rpartition("/")[2].startswith((".", "_"))


def read_files(spark: SparkSession, files: Sequence[tuple[str, str, int, int]], max_hidden_bytes: int = ScanOptions.max_hidden_bytes) -> DataFrame:
    """FILES of listed files: by Spark's tasks, and those that its sources leave out through the file system, of bounded size in all."""
    import datetime

    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path, rel, *_ in files if not is_hidden(rel)]
    hidden = [f for f in files if is_hidden(f[1])]
    if (size := sum(f[2] for f in hidden)) > max_hidden_bytes:
        raise ValueError(f"{size} bytes in files whose names begin with a dot or an underscore, over max_hidden_bytes")
    rows = []
    for path, _, length, modified in hidden:
        handle, fs = _open(spark, path)
        rows.append((path, length, datetime.datetime.fromtimestamp(modified / 1000), bytearray(_bytes(spark, handle, fs))))
    out = spark.createDataFrame(rows, FILES) if rows or not plain else None
    if plain:
        read = spark.read.format("binaryFile").load(plain)
        out = read if out is None else read.unionByName(out)
    return out


def scan(
    spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), project: str = "default", on_event: Callable[[str, str], None] | None = None
) -> DataFrame:
    """(project_id, path, rel_path, language, kind, size, modified, content, valid) of the files to index.

    Names that begin with a dot are listed like any other; excluded folders are not entered. Bytes that are not UTF-8 become
    U+FFFD, and valid is false for such a file. Folders that cannot be read are skipped. A missing root raises."""
    found = list_files(spark, root, options, on_event)
    return as_scanned(read_files(spark, found.files, options.max_hidden_bytes).withColumn("rel_path", relative(F.col("path"), root)), project)


def as_scanned(files: DataFrame, project: str) -> DataFrame:
    """The columns of scan() from FILES with rel_path."""
    return files.select(
        F.lit(project).alias("project_id"), "path", "rel_path", languages.language_of(F.col("rel_path")).alias("language"),
        languages.kind_of(F.col("rel_path")).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"),
    )


def scan_stats(found: Listing, spark: SparkSession) -> DataFrame:
    """(total_files, excluded_files, seconds): files kept, files left out of the folders that were entered, and how long it took."""
    return spark.createDataFrame([(found.total_files, found.excluded_files, found.seconds)], "total_files long, excluded_files long, seconds double")
