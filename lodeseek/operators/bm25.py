"""The inverted index and BM25 search.

Plans: tokens are exploded and filtered inside code generation, postings come from one partially aggregated
exchange on (document, term); a search reads only the postings of its terms (a filter that Parquet's row
groups prune when postings are sorted by term) and aggregates one row per posting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.text import is_token, raw_tokens
from lodeseek.session import shuffle_partitions_for

#: Text of a task that groups tokens with their positions.
POSITIONED_BYTES = 8 << 20


@dataclass(frozen=True)
class Params:
    k1: float = 1.5
    b: float = 0.75


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term): a row for each token."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(raw_tokens(F.col(text_col))).alias("term")).where(is_token(F.col("term")))


def positioned_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, term): position counts tokens from 0 after stop words are gone."""
    from lodeseek.functions.text import tokens

    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokens(F.col(text_col))).alias("position", "term"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_positions: bool = False) -> DataFrame:
    """(term, doc_id, frequency[, positions]).

    Positions take more room than the texts they are in, so with them texts are shuffled, by document, and tokens are grouped
    where they are, in tasks of so little text that their sorting needs no disk."""
    if with_positions:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
        whole = docs.select(id_col, text_col).repartition(shuffle_partitions_for(docs.sparkSession, size, POSITIONED_BYTES), id_col)
        rows = positioned_tokens(whole, id_col, text_col)
        return rows.groupBy("term", "doc_id").agg(F.count("*").alias("frequency"), F.array_sort(F.collect_list("position")).alias("positions"))
    return token_rows(docs, id_col, text_col).groupBy("term", "doc_id").agg(F.count("*").alias("frequency"))


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length); documents without a token have length 0 and count."""
    from lodeseek.functions.text import tokens

    return docs.select(F.col(id_col).alias("doc_id"), F.size(tokens(F.col(text_col))).cast("long").alias("length"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: documents and their mean length (0 for none)."""
    return stats.agg(F.count("*").alias("total_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def idf(df, total):
    return F.log((total - df + 0.5) / (df + 0.5) + 1)


def query_terms(spark: SparkSession, query: str) -> DataFrame:
    """(term, qn): the query's tokens with their number of repeats, which score repeatedly."""
    text = spark.range(1).select(F.lit(query).alias("text"))
    return text.select(F.explode(raw_tokens(F.col("text"))).alias("term")).where(is_token(F.col("term"))).groupBy("term").agg(F.count("*").alias("qn"))


def score_all(index: DataFrame, stats: DataFrame, query: str, params: Params = Params()) -> DataFrame:
    """(doc_id, score) of every document with a term of the query.

    The query's terms are at most its words and corpus statistics one row, so both are broadcast whatever the corpus."""
    spark = index.sparkSession
    terms = query_terms(spark, query)
    # As literals the query's words reach the scan, also below the anti-joins of a changed index: row groups of other terms are skipped.
    hits = index.where(F.col("term").isin([r.term for r in terms.collect()])).join(F.broadcast(terms), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row per term of the query
    lengths = stats.withColumnRenamed("length", "doc_length")
    joined = hits.join(F.broadcast(df), "term").join(lengths, "doc_id", "left").crossJoin(F.broadcast(corpus_stats(stats)))
    tf, n = F.col("frequency"), F.coalesce("doc_length", F.lit(0))
    norm = tf + params.k1 * (1 - params.b + params.b * n / F.col("avg_length"))
    part = F.col("qn") * idf(F.col("df"), F.col("total_docs")) * (tf * (params.k1 + 1)) / norm
    return joined.select("doc_id", part.alias("part")).groupBy("doc_id").agg(F.sum("part").alias("score"))


def search(index: DataFrame, stats: DataFrame, query: str, k: int = 10, params: Params = Params()) -> DataFrame:
    """The k best (doc_id, score), ties by id. A query without tokens returns no rows."""
    return score_all(index, stats, query, params).orderBy(F.desc("score"), "doc_id").limit(k)


def search_documents(docs: DataFrame, query: str, k: int = 10, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Search without a stored index, in one pass over the texts: tokens are exploded inside code generation and at once
    partially aggregated to a row per document (its length and each query term's frequency), which is all that is shuffled.
    Rows that share an id count as one document."""
    spark = docs.sparkSession
    terms = [(r.term, r.qn) for r in query_terms(spark, query).collect()]  # the query's words
    if not terms:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    counted = token_rows(docs, id_col, text_col).groupBy("doc_id").agg(
        F.count("*").alias("length"), *(F.count_if(F.col("term") == t).alias(f"f{i}") for i, (t, _) in enumerate(terms))
    )
    stats = counted.agg(F.sum("length").alias("tokens"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    total = docs.agg(F.count_distinct(id_col).alias("total_docs"))
    stats = stats.crossJoin(F.broadcast(total)).withColumn("avg_length", F.col("tokens") / F.col("total_docs"))
    score = F.lit(0.0)
    for i, (_, qn) in enumerate(terms):
        tf = F.col(f"f{i}")
        norm = tf + params.k1 * (1 - params.b + params.b * F.col("length") / F.col("avg_length"))
        score = score + F.when(tf > 0, qn * idf(F.col(f"df{i}"), F.col("total_docs")) * (tf * (params.k1 + 1)) / norm).otherwise(0.0)
    found = counted.where(" OR ".join(f"f{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    return found.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def peek_posting(index: DataFrame, term: str) -> DataFrame:
    return index.where(F.col("term") == term).orderBy("doc_id").limit(1)


def replace_documents(index: DataFrame, stats: DataFrame, changed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Index and statistics with the changed documents in place of their old entries."""
    ids = changed.select(F.col(id_col).alias("doc_id")).distinct()
    new_index = postings(changed, id_col, text_col)
    return (
        index.join(ids, "doc_id", "left_anti").select(*new_index.columns).unionByName(new_index),
        stats.join(ids, "doc_id", "left_anti").unionByName(doc_stats(changed, id_col, text_col)),
    )


def delete_documents(index: DataFrame, stats: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids (doc_id); those that are not there change nothing."""
    return index.join(ids, "doc_id", "left_anti"), stats.join(ids, "doc_id", "left_anti")
