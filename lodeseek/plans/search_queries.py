"""Tokens, the keyword index, vectors and hybrid ranking over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.text import STOP_WORDS, raw_tokens, tokens
from lodeseek.operators import bm25, hybrid, vectors
from lodeseek.operators.keyword_index import KeywordIndex
from lodeseek.plans.registry import Registry
from lodeseek.session import materialize, scratch_root, spread, table
from lodeseek.sources.store import Store

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

QUERY = "the thing stands onto edition hathe oned"
REPEATED = "oned oned thanon"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_BREAK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\-_@.,:;!?(){}\[\]<>/\\|\"''`~]+"


def split_sql(column: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({column}, '')), '{_BREAK}'), lambda t: t <> '' AND t NOT IN ({_STOP}))"


TOKENS = f"toks AS (SELECT doc_id, {split_sql('text')} AS ts FROM documents)"
FLAT = TOKENS + ", flat AS (SELECT doc_id, unnest(ts) AS term FROM toks)"
INDEX = FLAT + ", postings AS (SELECT term, doc_id, count(*) AS frequency FROM flat GROUP BY ALL), lens AS (SELECT doc_id, len(ts)::BIGINT AS length FROM toks)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@R.add(f"WITH {FLAT} SELECT doc_id, term, count(*)::BIGINT AS n FROM flat GROUP BY ALL")
def tokenize_documents(spark, sf_dir):
    return bm25.token_rows(docs(spark, sf_dir)).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@R.add(f"WITH {TOKENS} SELECT doc_id, len(ts)::BIGINT AS length FROM toks")
def token_counts(spark, sf_dir):
    return bm25.doc_stats(docs(spark, sf_dir))


@R.add(f"""
SELECT lang, sum(len(list_filter(ws, lambda t: t IN ({_STOP}))))::BIGINT AS stop_words, sum(len(ws))::BIGINT AS words,
       round(sum(len(list_filter(ws, lambda t: t IN ({_STOP})))) / sum(len(ws)), 6) AS share
FROM (SELECT lang, list_filter(string_split_regex(lower(coalesce(text, '')), '{_BREAK}'), lambda t: t <> '') AS ws FROM documents) GROUP BY lang""")
def stopword_share(spark, sf_dir):
    rows = docs(spark, sf_dir).select("lang", F.explode(raw_tokens(F.col("text"))).alias("t")).where("t <> ''")
    stop = F.count_if(F.col("t").isin(*STOP_WORDS))
    return rows.groupBy("lang").agg(stop.alias("stop_words"), F.count("*").alias("words"), F.round(stop / F.count("*"), 6).alias("share"))


@R.add(f"WITH {INDEX} SELECT * FROM postings")
def inverted_index(spark, sf_dir):
    return bm25.postings(docs(spark, sf_dir))


@R.add(f"""WITH {TOKENS}, pos AS (SELECT doc_id, unnest(ts) AS term, unnest(range(0, len(ts)))::INT AS p FROM toks)
SELECT term, doc_id, count(*)::BIGINT AS frequency, list(p ORDER BY p) AS positions FROM pos GROUP BY term, doc_id""")
def inverted_index_positions(spark, sf_dir):
    return bm25.postings(docs(spark, sf_dir), with_positions=True)


@R.add(f"WITH {INDEX} SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term")
def doc_frequency(spark, sf_dir):
    return bm25.document_frequency(bm25.postings(docs(spark, sf_dir)))


@R.add(f"WITH {TOKENS} SELECT count(*)::BIGINT AS total_docs, round(avg(len(ts)), 6) AS avg_length FROM toks")
def corpus_stats(spark, sf_dir):
    return bm25.corpus_stats(bm25.doc_stats(docs(spark, sf_dir))).select("total_docs", F.round("avg_length", 6).alias("avg_length"))


@R.add(f"""WITH {INDEX}, n AS (SELECT count(*) AS n FROM toks), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term)
SELECT term, df::BIGINT AS df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, n ORDER BY df DESC, term LIMIT 50""")
def idf_top_terms(spark, sf_dir):
    d = docs(spark, sf_dir)
    n = d.agg(F.count("*").alias("n"))
    df = bm25.document_frequency(bm25.postings(d)).orderBy(F.desc("df"), "term").limit(50)
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(bm25.idf(F.col("df"), F.col("n")), 6).alias("idf"))


def bm25_sql(query: str, k: int, k1: float = 1.5, b: float = 0.75) -> str:
    return f"""WITH {INDEX},
q AS (SELECT t AS term, count(*) AS qn FROM (SELECT unnest({split_sql(f"'{query}'")}) AS t) GROUP BY t),
s AS (SELECT count(*) AS n, avg(length) AS avgdl FROM lens),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term)
SELECT doc_id, round(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * (frequency * ({k1} + 1)) / (frequency + {k1} * (1 - {b} + {b} * length / avgdl))), 6) AS score
FROM postings JOIN q USING (term) JOIN df USING (term) JOIN lens USING (doc_id), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"""


def _bm25(spark, sf_dir, query, k, params=bm25.Params()):
    return bm25.search_documents(docs(spark, sf_dir), query, k, params).select("doc_id", F.round("score", 6).alias("score"))


@R.add(bm25_sql(QUERY, 20))
def bm25_search(spark, sf_dir):
    return _bm25(spark, sf_dir, QUERY, 20)


@R.add(bm25_sql(REPEATED, 20))
def bm25_repeated_terms(spark, sf_dir):
    return _bm25(spark, sf_dir, REPEATED, 20)


@R.add(bm25_sql(QUERY, 20, 1.2, 0.5))
def bm25_custom_params(spark, sf_dir):
    return _bm25(spark, sf_dir, QUERY, 20, bm25.Params(1.2, 0.5))


@R.add(bm25_sql("zzzqqq nowhere", 20))
def bm25_no_match(spark, sf_dir):
    return _bm25(spark, sf_dir, "zzzqqq nowhere", 20)


@R.add(bm25_sql(QUERY, 20))
def bm25_search_index(spark, sf_dir):
    d = docs(spark, sf_dir)
    # An index is stored before it is searched: neither its statistics nor its postings are counted again for each use.
    index, stats = materialize(bm25.postings(d), "postings", True), materialize(bm25.doc_stats(d), "doc_stats")
    return bm25.search(index, stats, QUERY, 20).select("doc_id", F.round("score", 6).alias("score"))


def _keyword_index(spark, sf_dir) -> KeywordIndex:
    index = KeywordIndex(Store(spark, f"{scratch_root(spark)}/lodeseek/keyword-{uuid.uuid4().hex}"))
    index.create(docs(spark, sf_dir))
    return index


@R.add(bm25_sql(QUERY, 20))
def bm25_block_index(spark, sf_dir):
    """A stored index of posting blocks, of which a search opens those whose bounds reach the k-th score."""
    return _keyword_index(spark, sf_dir).search(QUERY, 20).select("doc_id", F.round("score", 6).alias("score"))


@R.add("WITH before AS (SELECT * FROM documents), changed AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || ' oned oned' ELSE text END AS text "
       "FROM before WHERE doc_id % 9 <> 1), " + bm25_sql(QUERY, 20).removeprefix("WITH ").replace("FROM documents", "FROM changed"))
def bm25_block_index_changed(spark, sf_dir):
    """The same after a change: a ninth of the documents gains words, another ninth goes."""
    index, d = _keyword_index(spark, sf_dir), docs(spark, sf_dir)
    index.replace(d.where("doc_id % 9 = 0").select("doc_id", F.concat("text", F.lit(" oned oned")).alias("text")), d.where("doc_id % 9 = 1").select("doc_id"))
    return index.search(QUERY, 20).select("doc_id", F.round("score", 6).alias("score"))


@R.add(f"WITH {INDEX} SELECT * FROM postings WHERE term = 'oned' ORDER BY doc_id LIMIT 1")
def peek_posting(spark, sf_dir):
    return bm25.peek_posting(bm25.postings(docs(spark, sf_dir)), "oned")


@R.add(f"""WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'replaced text of document ' || doc_id ELSE text END AS text FROM documents),
toks AS (SELECT doc_id, {split_sql('text')} AS ts FROM changed), flat AS (SELECT doc_id, unnest(ts) AS term FROM toks)
SELECT term, count(*)::BIGINT AS df, sum(n)::BIGINT AS total FROM (SELECT term, doc_id, count(*) AS n FROM flat GROUP BY ALL) GROUP BY term""")
def reindex_document(spark, sf_dir):
    d = docs(spark, sf_dir)
    new = d.where("doc_id % 10 = 3").select("doc_id", F.concat(F.lit("replaced text of document "), F.col("doc_id").cast("string")).alias("text"))
    index, _ = bm25.replace_documents(bm25.postings(d), bm25.doc_stats(d), new)
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("frequency").alias("total"))


@R.add(f"""WITH {TOKENS} SELECT count(*)::BIGINT AS total_docs, round(avg(len(ts)), 6) AS avg_length FROM toks WHERE doc_id % 7 <> 0""")
def delete_documents(spark, sf_dir):
    d = docs(spark, sf_dir)
    _, stats = bm25.delete_documents(bm25.postings(d), bm25.doc_stats(d), d.where("doc_id % 7 = 0").select("doc_id"))
    return bm25.corpus_stats(stats).select("total_docs", F.round("avg_length", 6).alias("avg_length"))


# --- vectors

DIMS = 64
VECTOR = [round(0.02 * ((i * 7) % 11 - 5), 4) for i in range(DIMS)]
_VEC = "[" + ", ".join(f"{x!r}::DOUBLE" for x in VECTOR) + "]"
_ZIP = f"list_zip(embedding, {_VEC})"
_L2 = f"list_sum(list_transform({_ZIP}, lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))"
_COS = f"(list_sum(list_transform({_ZIP}, lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({_VEC}, lambda x: x * x)))))"


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _scored(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


@R.add(f"SELECT vec_id AS id, round(1 - {_L2}, 6) AS score FROM embeddings ORDER BY 1 - {_L2} DESC, vec_id LIMIT 20")
def vector_topk_l2(spark, sf_dir):
    return _scored(vectors.top_k(embeddings(spark, sf_dir), VECTOR, 20))


@R.add(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20")
def vector_topk_cosine(spark, sf_dir):
    return _scored(vectors.top_k(embeddings(spark, sf_dir), VECTOR, 20, "cosine"))


@R.add(f"SELECT vec_id AS id, round(1 - {_L2}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY 1 - {_L2} DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    return _scored(vectors.top_k(embeddings(spark, sf_dir), VECTOR, 10, filters={"label": 3}))


@R.add(f"SELECT vec_id AS id, round(1 - {_L2}, 6) AS score FROM embeddings ORDER BY 1 - {_L2} DESC, vec_id LIMIT 10")
def vector_topk_cells(spark, sf_dir):
    """Through cells, all of them probed: as exact as a scan. Recall with fewer is measured in the tests."""
    rows = embeddings(spark, sf_dir)
    centers = vectors.fit_cells(rows, cells=8)
    return _scored(vectors.top_k_in_cells(vectors.with_cell(rows, centers), centers, VECTOR, 10, probes=len(centers)))


@R.add("SELECT count(*)::BIGINT AS vector_count, max(len(embedding))::BIGINT AS dimension, (count(*) * max(len(embedding)) * 4)::BIGINT AS index_size FROM embeddings")
def collection_stats(spark, sf_dir):
    return vectors.collection_stats(embeddings(spark, sf_dir))


@R.add("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 98 FROM embeddings WHERE vec_id < 10""")
def upsert_vectors(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("vec_id", "label")
    new = rows.where("vec_id % 5 = 0").select("vec_id", F.lit(99).alias("label"))
    new = new.unionByName(rows.where("vec_id < 10").select((F.col("vec_id") + 1000000).alias("vec_id"), F.lit(98).alias("label")))
    return vectors.upsert(rows, new)


@R.add("SELECT vec_id, label FROM embeddings WHERE label <> 4")
def delete_vectors(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("vec_id", "label")
    return vectors.delete(rows, rows.where("label = 4"))


# --- hybrid


@R.add("""WITH s AS (SELECT doc_id AS id, n_chars::DOUBLE AS score FROM documents)
SELECT id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS norm FROM s""")
def minmax_normalize(spark, sf_dir):
    scores = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return hybrid.min_max(scores).select("id", F.round("norm", 6).alias("norm"))


@R.add("SELECT doc_id AS id, 1.0::DOUBLE AS norm FROM labels")
def minmax_all_equal(spark, sf_dir):
    return hybrid.min_max(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(5.0).alias("score"))).select("id", "norm")


@R.add("SELECT doc_id AS id, 1.0::DOUBLE AS norm FROM documents ORDER BY doc_id LIMIT 1")
def minmax_single(spark, sf_dir):
    one = docs(spark, sf_dir).orderBy("doc_id").limit(1).select(F.col("doc_id").alias("id"), F.lit(2.5).alias("score"))
    return hybrid.min_max(one).select("id", "norm")


def hybrid_sql(query: str, k: int, alpha: float, where: str = "TRUE") -> str:
    keyword = bm25_sql(query, 2 * k).replace("round(sum(", "(sum(").replace(", 6) AS score", ") AS score") if query else ""
    arm = keyword if query else "SELECT doc_id, 0.0::DOUBLE AS score FROM documents LIMIT 0"
    return f"""WITH kw AS ({arm}),
vec AS (SELECT vec_id, 1 - {_L2} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {2 * k}),
m AS (SELECT coalesce(doc_id, vec_id) AS id, coalesce(kw.score, 0) AS b, coalesce(vec.score, 0) AS v FROM kw FULL JOIN vec ON doc_id = vec_id),
x AS (SELECT *, min(b) OVER () AS lb, max(b) OVER () AS hb, min(v) OVER () AS lv, max(v) OVER () AS hv FROM m),
h AS (SELECT id, {alpha}::DOUBLE * CASE WHEN hb = lb THEN 1.0::DOUBLE ELSE (b - lb) / (hb - lb) END
             + (1 - {alpha}::DOUBLE) * CASE WHEN hv = lv THEN 1.0::DOUBLE ELSE (v - lv) / (hv - lv) END AS score FROM x)
SELECT id, round(score, 6) AS score FROM h LEFT JOIN documents d ON d.doc_id = id WHERE {where} ORDER BY h.score DESC, id LIMIT {k}"""


def _hybrid(spark, sf_dir, query, k, alpha, where=None, prefilter=False):
    d = docs(spark, sf_dir)
    keyword = bm25.search_documents(d, query, 2 * k).select(F.col("doc_id").alias("id"), "score")
    vector = vectors.top_k(embeddings(spark, sf_dir), VECTOR, 2 * k)
    meta = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("source").alias("file_type"))
    return _scored(hybrid.search(keyword, vector, k, hybrid.Mix(alpha), meta if where else None, where, prefilter))


@R.add(hybrid_sql(QUERY, 10, 0.3))
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, QUERY, 10, 0.3)


@R.add(hybrid_sql(QUERY, 10, 0.5))
def hybrid_alpha_half(spark, sf_dir):
    return _hybrid(spark, sf_dir, QUERY, 10, 0.5)


@R.add(hybrid_sql("", 10, 0.3))
def hybrid_empty_query(spark, sf_dir):
    return _hybrid(spark, sf_dir, "", 10, 0.3)


@R.add(hybrid_sql(QUERY, 10, 0.3, "d.lang IN ('en', 'fr')"))
def hybrid_lang_filter(spark, sf_dir):
    return _hybrid(spark, sf_dir, QUERY, 10, 0.3, hybrid.Filter(languages=["en", "fr"]))


@R.add(hybrid_sql(QUERY, 10, 0.3, "contains(id::VARCHAR, '1')"))
def hybrid_path_filter(spark, sf_dir):
    return _hybrid(spark, sf_dir, QUERY, 10, 0.3, hybrid.Filter(path="1"))


@R.add(hybrid_sql(QUERY, 10, 0.3, "d.lang IN ('en') AND d.source IN ('src0', 'src1', 'src2', 'src3') AND contains(id::VARCHAR, '2')"))
def hybrid_multi_filter(spark, sf_dir):
    return _hybrid(spark, sf_dir, QUERY, 10, 0.3, hybrid.Filter(languages=["en"], file_types=[".src0", "src1", "src2", "src3"], path="2"))


@R.add(f"""SELECT conv_id, count(*)::BIGINT AS turns, sum(len({split_sql('text')}))::BIGINT AS tokens FROM conversations GROUP BY conv_id""")
def conversation_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.size(tokens(F.col("text"))).alias("n"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("n").alias("tokens"))


@R.add("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
far AS (SELECT query_id, vec_id, 1 - list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS score FROM q, embeddings)
SELECT query_id, vec_id, round(score, 6) AS score FROM far QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def stored_vector_index(spark, sf_dir):
    """Every cell of a stored index is read and measured exactly, so the answer is the whole table's."""
    from lodeseek.operators.vector_index import StoredVectorIndex, search_many
    from lodeseek.session import scratch_root
    from lodeseek.sources.store import Store

    rows = table(spark, sf_dir, "embeddings")
    index = StoredVectorIndex(Store(spark, f"{scratch_root(spark)}/lodeseek/vector-index-{uuid.uuid4().hex}"), "embeddings")
    index.create(rows, cells=32)
    stored, coder = index.store.read("embeddings"), index.coder()
    return search_many(stored, coder, rows.where("vec_id % 50 = 0"), k=5, probes=len(coder.centers)).select(
        "query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score")
    )


@R.add()
def latent_vectors(spark, sf_dir):
    """Latent vectors of all documents, fitted on all of them (an iterative method: tests hold it against a singular value decomposition)."""
    from lodeseek.operators import latent

    rows = docs(spark, sf_dir)
    return latent.embed(rows, latent.fit(rows, latent.Settings(dimensions=32)))
