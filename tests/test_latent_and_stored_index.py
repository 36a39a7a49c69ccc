from __future__ import annotations

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import bm25, latent, vector_index, vectors
from lodeseek.sources.store import Conflict, Store

TOPICS = [["car", "automobile", "engine", "wheel", "road", "brake"], ["bread", "flour", "oven", "yeast", "dough", "crust"], ["river", "boat", "sail", "harbour", "anchor", "tide"]]


@pytest.fixture(scope="module")
def corpus(spark):
    """car and automobile never stand in one document, but in the same company."""
    rng, rows = random.Random(5), []
    for i in range(150):
        topic = TOPICS[i % 3]
        words = [rng.choice(topic[2:] if i % 3 == 0 else topic) for _ in range(12)]
        rows.append((i, " ".join([("car" if i % 2 else "automobile")] + words if i % 3 == 0 else words)))
    return spark.createDataFrame([*rows, (1000, None), (1001, "the of"), (1002, "unseenword")], "doc_id long, text string")


def dense(corpus):
    """The weights as one numpy matrix: (documents, terms, matrix)."""
    texts = {r.doc_id: latent.split_tokens(r.text) for r in corpus.collect()}
    df = {}
    for ws in texts.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    total = sum(bool(w) for w in texts.values())
    terms = sorted(t for t, n in df.items() if n >= 2)
    ids = sorted(i for i, ws in texts.items() if set(ws) & set(terms))
    a = np.zeros((len(ids), len(terms)))
    for row, i in enumerate(ids):
        for j, t in enumerate(terms):
            if n := texts[i].count(t):
                a[row, j] = (1 + np.log(n)) * (np.log((1 + total) / (1 + df[t])) + 1)
    return ids, terms, a / np.linalg.norm(a, axis=1, keepdims=True)


def test_vectors_are_the_singular_vectors(spark, corpus):
    ids, terms, a = dense(corpus)
    _, values, right = np.linalg.svd(a, full_matrices=False)
    model = latent.fit(corpus.repartition(5), latent.Settings(dimensions=6, extra=8, rounds=12))
    assert list(model.terms) == terms
    assert np.allclose(model.values, values[:6], rtol=1e-6)
    for own, theirs in zip(model.vectors.T[:3], right[:3]):
        assert abs(abs(own @ theirs) - 1) < 1e-4
    assert np.allclose(np.abs(model.vectors.T @ model.vectors), np.eye(6), atol=1e-8)


def test_the_tree_of_triangles(spark, corpus, monkeypatch):
    monkeypatch.setattr(latent, "FAN_IN", 2)
    monkeypatch.setattr(latent, "TASKS_PER_CORE", 4)
    ids, terms, a = dense(corpus)
    tokens = bm25.postings(corpus.where("doc_id < 2000"), "doc_id", "text")
    rows = latent.document_rows(tokens, latent.vocabulary(tokens, sum(1 for r in corpus.collect() if latent.split_tokens(r.text)), latent.Settings())).repartition(9)
    columns = np.random.RandomState(0).standard_normal((len(terms), 5))
    r = latent.triangle(rows, columns)
    assert np.allclose(r.T @ r, (a @ columns).T @ (a @ columns))
    assert np.allclose(latent.gram_product(rows, columns), a.T @ (a @ columns))


def test_a_synonym_finds_texts_without_the_word(spark, corpus):
    model = latent.fit(corpus, latent.Settings(dimensions=3))
    stored = latent.LatentModel.of_table(model.table(spark))
    assert stored.terms == model.terms and np.allclose(stored.vectors, model.vectors) and np.allclose(stored.values, model.values)
    embedder = latent.LatentEmbedder(stored)
    found = latent.embed(corpus, stored)
    rows = {r.doc_id: r.embedding for r in found.collect()}
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert rows.keys() == texts.keys() and not any(any(rows[i]) for i in (1000, 1001, 1002))
    assert all(np.allclose(rows[i], embedder.embed(texts[i])) for i in (0, 1, 2, 3))
    best = vectors.top_k(found.where("doc_id < 1000"), embedder.embed("automobile"), 50, "cosine", id_col="doc_id").collect()
    assert {r.id % 3 for r in best} == {0}
    assert sum("automobile" not in texts[r.id] for r in best) >= 20


def test_no_terms(spark, corpus):
    model = latent.fit(corpus.where("doc_id >= 1000"))
    assert model.terms == () and latent.embed(corpus, model).where("size(embedding) > 0").count() == 0
    assert latent.fit(corpus.limit(0)).terms == ()


def test_rows_of_texts_are_those_of_counted_tokens(spark, corpus, monkeypatch):
    monkeypatch.setattr(latent, "SLICE_BYTES", 200)  # so that a batch has many slices
    odd = [(2000, "Car\x0bROAD\u00a0river\ufeffboat\u3000sail -- car"), (2001, "\u0130stanbul ROAD wheel"), (2002, ""), (2003, " ".join(f"u{i}" for i in range(300)) + " road")]
    docs = corpus.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    tokens = bm25.postings(docs)
    df = {r.term: r.df for r in latent.document_frequency(docs.repartition(3)).collect()}
    assert df.pop(None) == tokens.agg(F.count_distinct("doc_id")).first()[0]
    assert df == {r.term: r.df for r in bm25.document_frequency(tokens).collect()}
    terms = latent.vocabulary(tokens, 150, latent.Settings())
    rows = lambda found: {r.doc_id: (r.terms, r.weights) for r in found.collect()}
    got, want = rows(latent.text_rows(docs, terms)), rows(latent.document_rows(tokens, terms))
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and np.allclose(got[i][1], want[i][1]) for i in want)


def test_fitting_shuffles_no_tokens_unless_ids_repeat(spark, corpus, monkeypatch):
    """Tokens of all documents were shuffled twice, and a row's length was summed anew for each of its terms."""
    whole = latent.fit(corpus, latent.Settings(dimensions=4))
    halves = corpus.select("doc_id", F.explode(F.array(F.split("text", " ", 2)[0], F.element_at(F.split("text", " ", 2), -1))).alias("text"))
    assert halves.count() > corpus.count()
    again = latent.fit(halves.where("text IS NOT NULL"), latent.Settings(dimensions=4))
    assert again.terms == whole.terms and np.allclose(again.idf, whole.idf)
    assert "aggregate(" not in latent.document_rows(bm25.postings(corpus), [("car", 1.0)])._jdf.queryExecution().toString()
    monkeypatch.setattr(bm25, "postings", lambda *_: pytest.fail("tokens are shuffled"))
    assert latent.fit(corpus, latent.Settings(dimensions=4)).terms == whole.terms


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.RandomState(2)
    middle = rng.standard_normal((20, 16))
    rows = [(i, (middle[i % 20] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(2000)]
    return spark.createDataFrame([*rows, (5000, None), (None, rows[0][1])], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    out = vector_index.StoredVectorIndex(Store(spark, f"file://{tmp_path_factory.mktemp('vectors')}"), "points")
    out.create(points, cells=24, books=4, codes=32)
    return out


def test_recall_and_exactness(spark, points, index):
    real = points.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    hits = 0
    for r in real.where("vec_id % 200 = 0").collect():
        want = [x.id for x in vectors.top_k(real, r.embedding, 10).collect()]
        hits += len(set(want) & {x.id for x in index.search(r.embedding, 10, probes=6).collect()})
        assert [x.id for x in index.search(r.embedding, 10, probes=24, rerank=None).collect()] == want
    assert hits >= 0.9 * 100


def test_only_near_cells_are_read(spark, index):
    plan = index.search([0.1] * 16, 5, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell_id" in plan or "PartitionFilters: [cell_id" in plan
    folders = {f.split("cell_id=")[1].split("/")[0] for f in index.store.read("points").inputFiles()}
    assert len(folders) > 15


def test_many_queries_as_one_by_one(spark, points, index):
    asked = points.where("vec_id % 250 = 0")
    got = vector_index.search_many(index.store.read("points"), index.coder(), asked, 5, probes=24)
    by_query = {}
    for r in got.orderBy("query_id", F.desc("score"), "id").collect():
        by_query.setdefault(r.query_id, []).append(r.id)
    real = points.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    for r in asked.where("embedding IS NOT NULL").collect():
        assert by_query[r.vec_id] == [x.id for x in vectors.top_k(real, r.embedding, 5).collect()]


def test_changes_keep_the_index(spark, points, tmp_path):
    own = vector_index.StoredVectorIndex(Store(spark, f"file://{tmp_path}"), "v")
    own.create(points.where("vec_id < 300"), cells=8)
    far = [9.0] * 16
    own.upsert(spark.createDataFrame([(7, far), (9000, far)], "vec_id long, embedding array<double>"))
    assert [r.id for r in own.search(far, 2, probes=1).collect()] == [7, 9000]
    own.delete(spark.createDataFrame([(7,), (123456,)], "vec_id long"))
    assert [r.id for r in own.search(far, 1, probes=8).collect()] == [9000]
    assert own.store.read("v").count() == 300


# Transactions


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def test_a_failure_between_tables_leaves_the_old_state(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    with store.transaction():
        store.write("a", numbers(spark, 1))
        store.write("b", numbers(spark, 1))
        assert store.read("a").count() == 1
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.change("a", numbers(spark, 2), None, ["n"])
        assert store.read("a").count() == 2 and Store(spark, store.root).read("a").count() == 1
        1 / 0  # noqa: B018
    other = Store(spark, store.root)
    assert other.read("a").count() == 1 and other.read("b").count() == 1
    store.change("b", numbers(spark, 5), None, ["n"])
    assert other.read("b").count() == 2 and not other.exists("c")
    store.drop("b")
    assert not other.exists("b") and not (tmp_path / "b").exists()


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}") for _ in range(2))
    one.write("t", numbers(spark, 0))
    with pytest.raises(Conflict), one.transaction():
        one.change("t", numbers(spark, 1), None, ["n"])
        two.change("t", numbers(spark, 2), None, ["n"])
    assert {r.n for r in one.read("t").collect()} == {0, 2}
    one.change("t", numbers(spark, 1), None, ["n"])
    assert {r.n for r in two.read("t").collect()} == {0, 1, 2}


def test_threads_have_transactions_of_their_own(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("t", numbers(spark, 0))
    failures = []

    def add(value):
        for _ in range(20):
            try:
                return store.change("t", numbers(spark, value), None, ["n"])
            except Conflict:
                continue
        failures.append(value)

    threads = [threading.Thread(target=add, args=(v,)) for v in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failures and {r.n for r in store.read("t").collect()} == {0, 1, 2, 3}


def test_the_engine_follows_its_changes(spark, tmp_path_factory):
    from lodeseek.service import Engine

    root = tmp_path_factory.mktemp("project")
    for i in range(12):
        (root / f"f{i}.py").write_text(f"def name{i}(rows):\n    '''Counts {TOPICS[i % 3][i % 5]} of rows'''\n    return {i}\n")
    engine = Engine(spark, f"file://{tmp_path_factory.mktemp('index')}")
    engine.index_project(rootPath=str(root))
    files = lambda: engine.get_index_status()["projects"][0]["total_files"]
    assert files() == 12
    (root / "g.py").write_text("def fresh(rows):\n    return rows\n")
    engine.update_file(f"{root}/g.py", str(root))
    assert files() == 13
    engine.learn_embedder(latent.Settings(dimensions=4))
    engine.index_vectors(cells=3, books=2, codes=4)
    engine.index_keywords()
    assert engine.search_code(query="fresh rows", topK=3)["results"][0]["name"] == "fresh"
    (root / "g.py").write_text("def renamed(rows):\n    return rows\n")
    engine.update_file(f"{root}/g.py", str(root))
    assert engine.search_code(query="renamed rows", topK=3)["results"][0]["name"] == "renamed"
    assert engine.store.read("chunk_index").count() == engine.store.read("chunks").count()
    engine.remove_file(f"{root}/g.py", str(root))
    assert engine.keywords.search("renamed").count() == 0 and engine.keywords.search("name3").count() == 1
    assert files() == 12 and engine.store.read("chunk_index").count() == engine.store.read("chunks").count()
    before = engine.store.read("files").count()
    broken, engine._totals = engine._totals, lambda project: 1 / 0
    with pytest.raises(ZeroDivisionError):
        engine.remove_file(f"{root}/f1.py", str(root))
    engine._totals = broken
    assert engine.store.read("files").count() == before


def test_many_queries_meet_the_index_in_bounded_blocks(spark, monkeypatch):
    """Small blocks, ties, vectors that repeat, NaN, infinity, huge and null numbers: as a fold of all pairs, and no join of rows."""
    from pyspark.sql import Window

    rng = np.random.RandomState(4)
    data = [(i, [float(v) for v in rng.randint(0, 4, 6)]) for i in range(300)]
    data += [(300, [float("nan")] * 6), (301, [float("inf")] * 6), (302, [1e200] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    coder = vector_index.Coder(rng.standard_normal((3, 6)), ())
    index = rows.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("int").alias("cell_id"), "embedding")
    for name, value in (("ROW_BLOCK", 70), ("QUERY_BLOCK", 5), ("TILE", 2), ("MEASURED", 100)):
        monkeypatch.setattr(vector_index, name, value)
    queries = rows.where("vec_id % 20 = 0 OR vec_id > 300")
    far = F.aggregate(F.zip_with("embedding", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = index.crossJoin(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).select("query_id", "id", (1 - far).alias("score"))
    want = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("_n <= 7").drop("_n")
    found = vector_index.search_many(index, coder, queries, k=7, probes=3)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    text = found._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text
    assert vector_index.search_many(index.limit(0), coder, queries, k=7).count() == 0
