"""Lines, context windows and result snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, content): one row per line, numbered from 1."""
    return files.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("n", "content")).select("id", (F.col("n") + 1).alias("line"), "content")


def context(content: Column, first: Column, last: Column, around: int = 3) -> Column:
    """Lines first - around .. last + around (1-based, cut at the file's ends), from the text itself: no line is exploded."""
    parts = F.split(content, "\n")
    start = F.greatest(F.lit(1), first - around)
    end = F.least(F.size(parts), last + around)
    return F.when(end >= start, F.array_join(F.slice(parts, start, end - start + 1), "\n")).otherwise("")


def head(content: Column, n: int = 20) -> Column:
    return F.array_join(F.slice(F.split(content, "\n"), 1, n), "\n")


def snippet(content: Column, first: Column, last: Column, around: int = 3, n: int = 20) -> Column:
    """The context of a hit, or a file's first lines where the hit has no line."""
    return F.when(first.isNull() | last.isNull(), head(content, n)).otherwise(context(content, first, last, around))


def context_rows(line_rows: DataFrame, around: int = 1) -> DataFrame:
    """(id, line, content, context): context by a row frame over each file's lines, for lines that are already rows."""
    frame = Window.partitionBy("id").orderBy("line").rowsBetween(-around, around)
    return line_rows.withColumn("context", F.array_join(F.collect_list("content").over(frame), "\n"))


def sliding_windows(line_rows: DataFrame, n: int) -> DataFrame:
    """(id, start_line, end_line, block): every full window of n lines."""
    frame = Window.partitionBy("id").orderBy("line").rowsBetween(0, n - 1)
    rows = line_rows.withColumn("_block", F.collect_list("content").over(frame)).where(F.size("_block") == n)
    return rows.select("id", F.col("line").alias("start_line"), (F.col("line") + n - 1).alias("end_line"), F.array_join("_block", "\n").alias("block"))


def title_and_snippet(docs: DataFrame, path_col: str = "path", text_col: str = "content", limit: int = 100) -> DataFrame:
    """(path, title, snippet): the first '#' line without its marks, else the file name; up to limit characters of the other lines."""
    parts = F.split(text_col, "\n")
    first = F.get(F.filter(parts, lambda x: F.trim(x).startswith("#")), F.lit(0))
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    title = F.coalesce(F.trim(F.regexp_replace(F.trim(first), "^#+", "")), name)
    rest = F.trim(F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")), " "))
    short = F.when(F.char_length(rest) > limit, F.concat(F.substring(rest, 1, limit), F.lit("..."))).otherwise(rest)
    return docs.select(F.col(path_col).alias("path"), title.alias("title"), short.alias("snippet"))
