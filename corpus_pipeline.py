"""From raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. Every stage works on all rows
that its predecessor kept and moves no text unless it must: decisions are columns or small tables of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import decontaminate, near_sets, packing, secret_scan, toxicity
from lodeseek.session import drop_paths, materialize, table, written_tables

TOXIC_FROM = 0.5
NEAR = near_sets.Settings(words=5, min_jaccard=0.8)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at TOXIC_FROM or more go.

    Null and empty texts are scored by no terms, alike; repeated rows are scored alike. Very long texts are scored whole. An
    empty table stays empty. All columns of docs stay, whatever their names and whatever is null in them."""
    score = toxicity.score_column(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) the smallest id stays.

    Null and empty texts are alike, so one of them stays. Rows that repeat an id are one document; rows without an id stay.
    Texts of any length are compared whole. An empty table stays empty; all columns of docs stay."""
    return near_sets.keep_one_of_each(docs, NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with up to a fifth of its words edited, go.

    Null and empty texts hold none. Repeated rows are judged alike. Very long texts are searched whole. An empty table, or an
    empty benchmark, changes nothing; all columns of docs stay."""
    leaks = decontaminate.leaks_column(table(spark, sf_dir, "benchmark"))
    return docs.where(~leaks(F.col("text")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, so the clean rest of a document stays; n_chars follows the text, null with it.

    No row goes; null and empty texts stay as they are, repeated rows alike. Very long texts are searched whole. docs
    without n_chars get none; an empty table stays empty."""
    text = secret_scan.redacted_column(docs)(F.col("text"))
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every id of what is left, in windows of 1024. Null and empty texts have the end id alone; repeated rows are packed
    each; very long texts are cut at windows; an empty table has no pieces. Other columns are not read."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]

#: A trained classifier and edit-distance search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables and its predecessor's rows are deleted once its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with written_tables() as made:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_paths(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
