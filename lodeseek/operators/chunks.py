"""Text units to embed and index: one per symbol, heading or code block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SNIPPET_CHARS = 500


def chunk_id(path, line):
    return F.concat_ws(":", path, line.cast("string"))


def build(symbols: DataFrame, files: DataFrame, project: str = "default") -> DataFrame:
    """symbols (path, ordinal, name, type, scope, docstring, line_start, line_end; lines from 1) with files (path, language, content)
    -> chunks: id, text = name, docstring and the symbol's own lines (500 characters at most), and typed metadata."""
    own = F.slice(F.split("content", "\n"), F.greatest(F.col("line_start"), F.lit(1)), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(1)))
    joined = symbols.join(files, "path")
    return joined.select(
        chunk_id(F.col("path"), F.col("line_start")).alias("id"),
        F.concat_ws("\n", "name", F.nullif(F.col("docstring"), F.lit("")), F.substring(F.array_join(own, "\n"), 1, SNIPPET_CHARS)).alias("text"),
        F.lit(project).alias("project_id"), F.col("path").alias("file_path"), "language",
        F.regexp_extract("path", r"\.([^./]+)$", 1).alias("file_type"), "type", "name", "scope", "line_start", "line_end", "ordinal",
    )


def keep_last(chunks: DataFrame, id_col: str = "id", order_col: str = "ordinal") -> DataFrame:
    """Of chunks that share an id the one emitted last."""
    newest = Window.partitionBy(id_col).orderBy(F.desc(order_col))
    return chunks.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def in_groups(rows: DataFrame, size: int, order_col: str) -> DataFrame:
    """Numbers fixed-size groups of a bounded table in order (batches to send to an external service)."""
    return rows.withColumn("group", F.floor((F.row_number().over(Window.orderBy(order_col)) - 1) / size))
