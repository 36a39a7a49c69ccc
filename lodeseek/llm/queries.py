"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import license_scan
from lodeseek.llm.url_filter import HOST_WORDS, PATH_ENDS, PATH_PARTS
from lodeseek.session import table


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.sharding import shard

    found = shard(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm import quality

    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id").drop("globs")


OP5_SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN {" OR ".join(f"contains(host, '{w}')" for w in HOST_WORDS)}
         OR {" OR ".join(f"contains(path, '{p}')" for p in PATH_PARTS)}
         OR {" OR ".join(f"ends_with(path, '{e}')" for e in PATH_ENDS)} THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm import secret_scan

    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").drop("redacted")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.imatch import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.alignment import align_and_count

    return align_and_count(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.lexical_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20).withColumnRenamed("id", "doc_id")


_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
total AS (SELECT count(*) AS n_docs, sum(len(ws)) AS n_words FROM d WHERE len(ws) > 0),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, total GROUP BY term),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""


def op13_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeseek.llm.vector_topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10).withColumnRenamed("id", "vec_id")


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_fm": op1_toxicity_fm,
    "op2_decontaminate_cgk": op2_decontaminate_cgk,
    "op3_kd_shards": op3_kd_shards,
    "op4_quality_knn": op4_quality_knn,
    "op5_url_automaton": op5_url_automaton,
    "op6_secrets": op6_secrets,
    "op7_simhash_golay": op7_simhash_golay,
    "op8_license_diagonals": op8_license_diagonals,
    "op9_imatch": op9_imatch,
    "op10_pack_nnls": op10_pack_nnls,
    "op11_align_tokens": op11_align_tokens,
    "op12_block_max_wand": op12_block_max_wand,
    "op13_vector_topk": op13_vector_topk,
}

ORACLES: dict[str, str] = {"op5_url_automaton": OP5_SQL, "op8_license_diagonals": license_scan.oracle_sql(), "op12_block_max_wand": OP12_SQL, "op13_vector_topk": OP13_SQL}
