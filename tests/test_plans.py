"""What the plans must look like: pushed filters, pruned columns, no Python or cross products on hot paths."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import bm25, linking, symbols, vectors


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.range(100).select(
        F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"), (F.col("id") % 3).alias("label"), F.lit("x").alias("payload")
    ).write.parquet(f"{root}/vectors")
    spark.range(100).select(
        F.col("id").cast("string").alias("file_path"), F.lit("n").alias("name"), F.lit("function").alias("type"), F.lit("p").alias("project_id"), F.lit("g").alias("scope"),
        F.lit(1).alias("line_start"), F.lit(2).alias("line_end"),
    ).write.parquet(f"{root}/chunks")
    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.lit("x").alias("payload")).write.parquet(f"{root}/docs")
    return root


def test_filtered_vector_search_reads_what_it_needs(spark, stored):
    text = plan(vectors.top_k(spark.read.parquet(f"{stored}/vectors"), [1.0, 2.0], 3, filters={"label": 1}))
    assert "EqualTo(label,1)" in text and "payload" not in text and "TakeOrderedAndProject" in text and "Python" not in text


def test_definitions_are_a_filtered_scan(spark, stored):
    text = plan(symbols.definitions(spark.read.parquet(f"{stored}/chunks"), "n", "function"))
    assert "EqualTo(name,n)" in text and "EqualTo(type,function)" in text and "Exchange" not in text.replace("BroadcastExchange", "")


def test_postings_take_one_exchange_with_partial_aggregation(spark, stored):
    text = plan(bm25.postings(spark.read.parquet(f"{stored}/docs")))
    assert text.count(") Exchange") == 1 and "partial_count" in text and "payload" not in text and "Python" not in text


def test_positions_are_grouped_where_the_texts_are(spark, stored):
    """One exchange, of texts below the tokens; rows that share an id are one document."""
    docs = spark.read.parquet(f"{stored}/docs")
    text = plan(bm25.postings(docs, with_positions=True)).split("\n\n")[0]
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange") and "Python" not in text
    twice = docs.where("doc_id = 3").union(docs.where("doc_id = 3"))
    assert {r.term: (r.frequency, r.positions) for r in bm25.postings(twice, with_positions=True).collect()} == {"some": (2, [0, 0]), "words": (2, [1, 1]), "here": (2, [2, 2])}


def test_search_over_texts_shuffles_a_row_per_document(spark, stored):
    text = plan(bm25.search_documents(spark.read.parquet(f"{stored}/docs"), "some words"))
    assert "partial_count" in text and "SortMergeJoin" not in text and "Python" not in text and "payload" not in text


def test_suffix_links_are_equi_joins(spark):
    refs = spark.createDataFrame([("d", "a.py", "/w/a.py")], "doc_path string, ref string, resolved string")
    files = spark.createDataFrame([("/w/x/a.py",), ("/w/b.py",)], "file_path string")
    text = plan(linking.path_links(refs, files))
    assert "CartesianProduct" not in text and linking.path_links(refs, files).count() == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_similarity_compares_query_items_with_all(spark, tmp_path):
    from lodeseek.plans.code_queries import levenshtein_similarity

    texts = {i: f"ítem {i} über {'x' * (i % 7)}" for i in range(120)}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.a, r.b): r.similarity for r in levenshtein_similarity(spark, str(tmp_path)).collect()}
    assert got.keys() == {(a, b) for a in (0, 50, 100) for b in range(120) if a != b}
    assert all(abs(s - (1 - edits(texts[a], texts[b]) / max(len(texts[a]), len(texts[b])))) < 1e-6 for (a, b), s in got.items())


def test_distances_by_columns_match_the_plain_table():
    import random

    import numpy as np

    from lodeseek.functions.editing import Texts, distances

    rng = random.Random(8)
    texts = ["", "a", "x" * 200] + ["".join(rng.choices("abcé😀", k=rng.choice((1, 5, 63, 64, 65, 130)))) for _ in range(40)]
    found = Texts(texts)
    for pattern in ["", "zzz", *texts[1:12]]:
        got = distances(pattern, found, 0, len(texts))
        assert got.tolist() == [edits(pattern, texts[i]) for i in found.order]
    lo, hi = found.between(5, 65)
    assert sorted(len(texts[i]) for i in found.order[lo:hi]) == sorted(len(t) for t in texts if 5 <= len(t) <= 65)
    assert np.array_equal(distances("ab", found, lo, hi), distances("ab", found, 0, len(texts))[lo:hi])


@pytest.mark.parametrize("most", [20_000, 0])
def test_similar_windows_match_brute_force(spark, tmp_path, monkeypatch, most):
    import random

    monkeypatch.setattr(linking, "MAX_BLOCKS", most)

    from lodeseek.plans.code_queries import similar_code_windows

    rng = random.Random(1)
    line = lambda: rng.choice(["", "// note", "  x = é + 1", "y = a" * rng.randint(1, 6), "".join(rng.choices("ab =é", k=rng.randint(0, 40)))])
    texts = {i: "\n".join(line() for _ in range(rng.randint(1, 6))) for i in range(160)}
    spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in texts.items()], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    norm = lambda ls: "\n".join(x for x in (s.strip(" ") for s in ls) if x and not x.startswith(("//", "#")))
    windows = [(i, n + 1, norm(t.split("\n")[n : n + 2])) for i, t in texts.items() for n in range(len(t.split("\n")) - 1)]
    want = {}
    for block, start, code in windows:
        if start == 1 and block % 50 == 0:
            for i, n, other in windows:
                longest = max(len(code), len(other))
                score = 1.0 if not longest else 1 - edits(code, other) / longest
                if score >= 0.5:
                    want[(block, str(i), n)] = round(score, 6)
    got = {(r.block_id, r.file_path, r.start_line): r.similarity for r in similar_code_windows(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 20


def test_bounded_edit_distances_are_those_of_the_whole_matrix():
    """Pairs beyond their bound are given up and rows far from the last diagonal are left out; what is within stays exact."""
    import random

    import numpy as np

    from lodeseek.functions.editing import Texts, distances, distances_within, word_count

    rng = random.Random(5)

    def edited(text: str) -> str:
        out = list(text)
        for _ in range(rng.randint(0, len(text) * 2 // 3 + 1)):
            at = rng.randint(0, len(out))
            out[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "日"])
        return "".join(out)

    for n in (0, 1, 63, 64, 65, 200):
        base = "".join(rng.choices("abcé", k=n))
        patterns = [p for p in [base, *(edited(base) for _ in range(4))] if word_count(p) == word_count(base)]
        texts = Texts(["", *(edited(base) for _ in range(20)), *("".join(rng.choices("abcé", k=rng.randint(0, 250))) for _ in range(20))])
        text, pattern = np.divmod(np.arange(len(texts.length) * len(patterns)), len(patterns))
        longest = np.maximum(texts.length[text], np.array([len(p) for p in patterns])[pattern])
        exact = np.stack([distances(p, texts, 0, len(texts.length)) for p in patterns])[pattern, text]
        for threshold in (0.2, 0.5, 0.8):
            most = np.floor((1 - threshold) * longest + 1e-9).astype(int)
            assert (distances_within(patterns, texts, pattern, text, most) == np.where(exact <= most, exact, -1)).all()


def test_a_long_text_does_not_widen_the_columns_of_others():
    """One text of 100,000 characters among many short ones took a table of its length for all of them."""
    from lodeseek.functions.editing import Texts
    from lodeseek.operators.linking import GROUP_CHARACTERS, _chunks_of_like_length

    texts = ["x" * 100_000, *(f"short text {i}" for i in range(3000))]
    chunks = list(_chunks_of_like_length(texts))
    assert sorted(t for c in chunks for t in c) == sorted(texts)
    assert all(Texts(c).columns.size <= GROUP_CHARACTERS for c in chunks)


def test_unlike_texts_are_left_out_before_their_distances_are_computed():
    """Texts of the same syllables, whose distances are far beyond the bound, were all compared by columns of distances."""
    import random

    import numpy as np

    from lodeseek.functions.editing import Texts, distances, may_be_within
    from lodeseek.operators.linking import _similar

    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", " ", "nd", "ha", ", ", "tion", "st"]) for _ in range(n))

    def edited(text: str, times: int) -> str:
        out = list(text)
        for _ in range(times):
            at = rng.randint(0, len(out))
            out[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "é", "日"])
        return "".join(out)

    blocks = [prose(n) for n in (1, 30, 60, 130, 200, 260)] + ["x" * 700, "ab" * 900]
    near = [edited(b, rng.randint(0, len(b) * 2 // 3)) for b in blocks for _ in range(6)]
    moved = [b[len(b) // 3 :] + b[: len(b) // 3] for b in blocks] + [b + b[: len(b) // 2] for b in blocks] + ["", "x" * 300 + "ab" * 400]
    texts = Texts([*near, *moved, *(prose(rng.randint(60, 300)) for _ in range(60))])
    text, pattern = np.divmod(np.arange(len(texts.length) * len(blocks)), len(blocks))
    longest = np.maximum(texts.length[text], np.array([len(b) for b in blocks])[pattern])
    exact = np.stack([distances(b, texts, 0, len(texts.length)) for b in blocks])[pattern, text]
    for most in (longest // 5, longest // 2, longest * 4 // 5, exact, np.maximum(exact - 1, 0)):
        assert may_be_within(blocks, texts, pattern, text, most)[exact <= most].all()
    kept = may_be_within(blocks, texts, pattern, text, longest // 2)
    unlike = (exact > 0.6 * longest) & (longest > 200)
    assert unlike.sum() > 300 and (kept & unlike).sum() < 0.1 * unlike.sum()  # turned ones have much in common
    got = {(b, t): s for b, t, s in _similar(blocks, texts, 0.5)}
    want = {(blocks[p], int(t)): 1 - e / max(n, 1) for p, t, e, n in zip(pattern, text, exact, longest) if 1 - e / max(n, 1) >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
