from __future__ import annotations

import numpy as np
import pytest

from lodeseek.llm import decontaminate as D
from tests.llm.conftest import CLASHING, frame, prose


def edit_distance_to_span(p, t):
    """Least edit distance of p to any span of t, by the plain table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance_is_exact(rng):
    for _ in range(300):
        p = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 70))]
        t = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 90))]
        assert D.best_span(p, t)[0] == edit_distance_to_span(p, t)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[at] = "zz" + str(rng.randrange(99))
        elif kind < 0.75 and len(out) > 3:
            del out[at]
        else:
            out.insert(at, "yy")
    return out


@pytest.mark.parametrize("share, least", [(0.0, 1.0), (0.1, 0.98), (0.2, 0.93)])
def test_recall_against_brute_force(rng, share, least):
    s = D.Settings()
    items = [(i, " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(rng.randint(14, 59)))) for i in range(60)]
    built = D.build_items(items, s)
    texts = [" ".join([prose(rng, 80), *edited(rng, t.split(), int(share * len(t.split()))), prose(rng, 80)]) for _, t in items]
    want = {
        (d, i) for d, t in enumerate(texts) for i, words in enumerate(built.words)
        if len(set(words) & set(D.words_of(t.encode()))) >= 0.7 * len(set(words)) and edit_distance_to_span(words, D.words_of(t.encode())) <= int(s.max_edit_share * len(words))
    }
    got = {(d, i) for d, i, *_ in D.scan([t.encode() for t in texts], built, s)}
    assert got <= want and len(got & want) >= least * len(want) and len(want) >= 55


@pytest.mark.parametrize("words", [*range(1, 20), 22, 24, 29, 30, 34, 45, 60])
def test_every_length_is_found_at_the_full_edit_share(rng, words):
    """Items of one length with floor(n / 5) words edited, and verbatim: all are found under 30 words, 98 % from there on."""
    s = D.Settings()
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(words))) for i in range(100)]
    built = D.build_items(items, s)
    for edits in (0, int(s.max_edit_share * words)):
        texts = [" ".join([prose(rng, 40), *edited(rng, t.split(), edits), prose(rng, 40)]) for _, t in items]
        got = {(d, i) for d, i, *_ in D.scan([t.encode() for t in texts], built, s)}
        assert len(got & {(i, i) for i in range(100)}) >= (100 if words < 30 or not edits else 98)


def test_walks_meet_again_after_an_edit(rng):
    """The embedding's point: one edit leaves most outputs alike, unrelated text leaves few."""
    words = [f"w{rng.randrange(10**6)}".encode() for _ in range(80)]
    other = words[:5] + [b"changed"] + words[6:]
    s = D.Settings(classes=((1, 18, 18),), keys_per_walk=1, walks=3)
    same = [np.mean(a[6:60] == b[6:60]) for (_, a, _), (_, b, _) in zip(D.walk_keys(D.symbols_of(words), s, {0}), D.walk_keys(D.symbols_of(other), s, {0}))]
    assert all(x == 1 for x in same)


def test_leaks_over_tables(spark, rng, oddities):
    item = "the Quick, brown fox jumps over the lazy dog near nine quiet rivers"
    texts = [prose(rng, 50) + " " + item.upper() + ". " + prose(rng, 5000), item, prose(rng, 60), item.replace("lazy", "sleepy"), *oddities]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, item), (10, "too short")], "item_id long, text string")
    docs = frame(spark, texts, CLASHING)
    got = {(r.id, r.item_id, r.edits) for r in D.find_leaks(docs, bench).collect()}
    assert got == {(0, 7, 0), (1, 7, 0), (3, 7, 1)}
    column = D.leaks_column(bench)
    assert {r.doc_id for r in docs.where(column(docs["text"])).collect()} == {0, 1, 3}
    assert D.find_leaks(docs.unionByName(docs), bench).count() == 6
    assert D.find_leaks(docs, bench.limit(0)).count() == 0 and D.find_leaks(docs.limit(0), bench).count() == 0
    for few in (D.Settings(max_items=2), D.Settings(max_item_bytes=20)):
        with pytest.raises(ValueError):
            D.find_leaks(docs, bench, few)


def test_items_that_share_a_prompt(rng):
    """2,000 items begin with the same 14 words: found as by brute force, without an edit distance for each of them."""
    import time

    s = D.Settings()
    prompt = [f"prompt{i}" for i in range(14)]
    items = [(i, " ".join([*prompt, *("".join(rng.choices("abcdef", k=6)) for _ in range(rng.choice((8, 12, 30))))])) for i in range(2000)]
    built = D.build_items(items, s)
    texts = [" ".join([*prompt, *prose(rng, 40).split()])] * 20
    texts += [" ".join([prose(rng, 30), *edited(rng, items[i][1].split(), int(share * len(items[i][1].split()))), prose(rng, 30)]) for i in range(20) for share in (0, 0.2)]
    began = time.time()
    got = {(d, i) for d, i, *_ in D.scan([t.encode() for t in texts], built, s)}
    assert time.time() - began < 20
    parts = [D.words_of(t.encode()) for t in texts]
    want = {(20 + 2 * i + k, i) for i in range(20) for k in range(2) if edit_distance_to_span(built.words[i], parts[20 + 2 * i + k]) <= int(0.2 * len(built.words[i]))}
    assert len(want) >= 38 and len(got & want) >= 0.98 * len(want)
    assert all(edit_distance_to_span(built.words[i], parts[d]) <= int(0.2 * len(built.words[i])) for d, i in got)


def test_lookups_drop_no_item_within_the_edits(rng):
    s = D.Settings()
    items = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(5, 40)))) for i in range(60)]
    built = D.build_items(items, s)
    for i in range(60):
        window = D.symbols_of(edited(rng, [w.decode() for w in built.words[i]], int(0.2 * len(built.words[i]))))
        assert D.likely(built, np.arange(60), np.array(window), s)[i]


@pytest.mark.parametrize("words", [4, 6, 9, 10, 14, 19, 24, 29, 30, 45, 60])
def test_walks_alone_find_nine_of_ten_of_each_class(rng, words):
    """Without the further keys of short items, at the full edit share and verbatim."""
    s = D.Settings(exact_below_words=0)
    items = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(words))) for i in range(300)]
    built = D.build_items(items, s)
    assert not built.runs and built.walked == {D.class_of(words, s)}
    for edits in {0, words // 5}:
        texts = [" ".join([prose(rng, 40), *edited(rng, t.split(), edits), prose(rng, 40)]) for _, t in items]
        want = {d for d, t in enumerate(texts) if edit_distance_to_span(built.words[d], D.words_of(t.encode())) <= int(s.max_edit_share * words)}
        got = {d for d, i, *_ in D.scan([t.encode() for t in texts], built, s) if d == i}
        assert got <= want and len(got) >= 0.9 * len(want), (edits, len(got) / len(want))
