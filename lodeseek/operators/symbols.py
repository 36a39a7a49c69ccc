"""Symbol lookups over chunk metadata and file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import occurrences


def definitions(chunks: DataFrame, name: str, kind: str | None = None, project: str | None = None, scope: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks of that symbol with a file and lines; a plain filtered scan, its predicates reach Parquet. With a limit the first by place."""
    rows = chunks.where(F.col("name") == name)
    for column, value in (("type", kind), ("project_id", project), ("scope", scope)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rows = rows.dropna(subset=["file_path", "line_start", "line_end"])
    return rows if limit is None else rows.orderBy("file_path", "line_start").limit(limit)


def distinct_files(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path").where(F.col("file_path").isNotNull()).distinct()


def references(files: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line from 1, column from 0, context of one line around): every occurrence, overlapping ones too.

    Files without the name are dropped by a substring test in the scan's stage, before any line is exploded."""
    hit = files.where(F.col(text_col).contains(name)) if name else files.limit(0)
    parts = F.split(text_col, "\n")

    def found(line, n):  # n from 0; only lines with the name become rows, each with its own context
        start = F.greatest(F.lit(1), n)
        context = F.array_join(F.slice(parts, start, F.least(F.size(parts), n + 2) - start + 1), "\n")
        return F.when(line.contains(name), F.struct((n + 1).alias("line"), context.alias("context"), occurrences(line, name).alias("columns")))

    each = hit.select(F.col(id_col).alias("id"), F.explode(F.filter(F.transform(parts, found), lambda x: x.isNotNull())).alias("_l"))
    return each.select("id", F.col("_l.line").alias("line"), F.col("_l.context").alias("context"), F.explode("_l.columns").alias("column"))


def comment_symbols(comments: DataFrame, symbols: DataFrame, reach: int = 3) -> DataFrame:
    """Each comment (path, comment_id, end_line) with the first symbol (by ordinal) that starts within reach lines after its end.

    The range condition is an equi-join: a comment proposes each of its next lines."""
    ahead = comments.withColumn("line", F.explode(F.sequence(F.col("end_line") + 1, F.col("end_line") + reach)))
    found = ahead.join(symbols.select("path", "line", "ordinal", "name"), ["path", "line"])
    best = found.groupBy("path", "comment_id").agg(F.min_by("name", "ordinal").alias("symbol"))
    return comments.join(best, ["path", "comment_id"], "left")
