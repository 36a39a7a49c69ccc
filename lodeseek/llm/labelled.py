"""Bounded samples of labelled rows and the fold that learning must not see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str | Column) -> Column:
    """True for rows whose crc32 of the id as text leaves no remainder by five; null ids are not held out."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample_labels(labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label 0/1) of at most max_rows labelled rows outside the held-out fold, those of the smallest id hashes,
    so the same rows whatever the partitioning. An id that repeats counts once, with its largest label."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col))
    once = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return once.orderBy(F.xxhash64(F.col("id"), F.lit(label)), "id").limit(max_rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, _t) of the sample; its ids (at most max_rows, so a proven bound) are broadcast, texts stay where they are."""
    spark = docs.sparkSession
    rows = [(r.id, r.label) for r in sample_labels(labels, label, max_rows, id_col).collect()]
    chosen = spark.createDataFrame(rows, "id long, label int")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "id")
