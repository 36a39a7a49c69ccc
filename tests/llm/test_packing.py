from __future__ import annotations

import zlib

import numpy as np
import pytest

from lodeseek.llm import packing as P
from tests.llm.conftest import CLASHING, frame, prose


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def check_packing(rows, ids, window):
    """Every id in exactly one piece, sequences gapless and within the window; returns the sequences' lengths."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[doc])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return [sum(r.length for r in pieces) for pieces in by_seq.values()]


@pytest.mark.parametrize("window", [1024, 64])
def test_round_trip(spark, rng, oddities, reference, window):
    texts = [prose(rng, rng.randint(0, 400)) for _ in range(150)] + ["same text here"] * 60 + oddities
    docs = frame(spark, texts, CLASHING)
    rows = P.pack(docs, window).collect()
    lengths = check_packing(rows, {i: reference(t) for i, t in enumerate(texts)}, window)
    assert sum(x < window for x in lengths) <= 1


def test_ids_are_the_tokenizers(oddities, reference, rng):
    for text in [*oddities, prose(rng, 300), "I'll 12,345 x y\r\n\r\n  z 'S", "<|endoftextx|>", "​﻿ ﬁ"]:
        assert np.array_equal(P.ids_of(text, P.default_vocabulary()), reference(text))


def test_solution_fills_windows():
    rng = np.random.RandomState(1)
    window = 128
    combos = P.combinations(window)
    assert all(sum(c) == window for c in combos) and len(set(combos)) == len(combos)
    wanted = np.zeros(window + 1, dtype=np.int64)
    for j in rng.randint(0, len(combos), 40):
        for length in combos[j]:
            wanted[length] += 25
    x = P.solve_counts(wanted, combos)
    fit = np.zeros(window + 1)
    for n, c in zip(x, combos):
        for length in c:
            fit[length] += n
    assert (x >= 0).all() and np.abs(fit - wanted).sum() <= 0.05 * wanted.sum()
    counts, left = P.round_counts(x, combos, wanted)
    assert (left >= 0).all() and left.sum() <= 0.4 * wanted.sum() and (counts >= 0).all()


def test_a_hot_length_and_no_rows(spark, reference):
    docs = frame(spark, ["one two three four"] * 500)
    ids = reference("one two three four")
    rows = P.pack(docs, 16).collect()
    lengths = check_packing(rows, {i: ids for i in range(500)}, 16)
    assert sum(lengths) == 500 * len(ids) and sum(x < 16 for x in lengths) <= 1
    assert P.pack(docs.limit(0)).count() == 0


def test_repeated_rows_are_packed_each(spark, reference):
    docs = frame(spark, ["alpha beta", "gamma"])
    got = P.pack(docs.unionByName(docs)).groupBy("id").sum("length").collect()
    assert {r.id: r["sum(length)"] for r in got} == {0: 2 * len(reference("alpha beta")), 1: 2 * len(reference("gamma"))}


def test_the_special_token_in_a_text_is_one_id(reference):
    for text in ["<|endoftext|>", "one <|endoftext|> two", "x<|endoftext|><|endoftext|>\n<|endoftext", " <|endoftext|>  'S"]:
        ids = P.ids_of(text, P.default_vocabulary())
        assert 50256 in ids and ids.tolist() == reference(text).tolist()


@pytest.mark.parametrize("blank", [" ", "\n", "\t"])
def test_two_million_blanks(reference, blank):
    text = "a" + blank * 2_000_000 + "b"
    assert np.array_equal(P.ids_of(text, P.default_vocabulary()), reference(text))


def test_blanks_are_packed(spark, reference):
    texts = ["x" + " " * 1_200_000, "short", "\n" * 1_200_000]
    check_packing(P.pack(frame(spark, texts)).collect(), {i: reference(t) for i, t in enumerate(texts)}, 1024)
