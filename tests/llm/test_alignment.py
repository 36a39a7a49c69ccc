from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from lodeseek.llm import alignment as A
from lodeseek.llm import vocabularies as V
from tests.llm.conftest import CLASHING, frame, prose


@pytest.fixture(scope="module")
def encoders():
    import json

    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = {}
    for byte in range(256):
        plain = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255
        letters[chr(byte if plain else 256 + sum(not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174) for b in range(byte)))] = byte
    words = {i: bytes(letters[c] for c in w) for w, i in json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return a, words, b


def brute(text, encoders):
    """(A ids, B ids, groups, links) of one text, a token at a time."""
    a, words, b = encoders
    if not text:
        return [], [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [words[i] for i in ids_a]
    bytes_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], [], []
    ends = [np.cumsum([len(x) for x in xs]).tolist() for xs in (bytes_a, bytes_b)]
    groups, links, lo_a, lo_b = [], [], 0, 0
    after = [{end: i + 1 for i, end in enumerate(e)} for e in ends]
    for end in sorted(set(ends[0]) & set(ends[1])):
        hi_a, hi_b = after[0][end], after[1][end]
        groups.append(",".join(map(str, ids_a[lo_a:hi_a])) + "|" + ",".join(map(str, ids_b[lo_b:hi_b])))
        links.append((ids_a[hi_a - 1], ids_b[hi_b - 1]))
        lo_a, lo_b = hi_a, hi_b
    return ids_a, ids_b, groups, links


def expected(texts, encoders):
    found = [brute(t, encoders) for t in texts]
    count = Counter(x for *_, links in found for x in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (i, len(a), len(b), len(g), len(k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k))
        for i, (a, b, g, k) in enumerate(found)
    ]


def answer(df):
    return sorted((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in df.collect())


EDGES = ["<|endoftext|> x", "<s> </s> <unk>", "a▁b", "  two  blanks ", " ", "\n", "\t\r\n", "é", "\U0001f600\U0001f600", "ﬁ ①", "İK ſ", "I'll 12,345", "中文字", "x\x00y", "a​b", "<0x41>"]


@pytest.mark.parametrize("max_pairs, chunk", [(1_000_000, 4 << 20), (25, 300), (0, 1)])
def test_as_by_brute_force(spark, rng, oddities, encoders, monkeypatch, max_pairs, chunk):
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(60)] + ["the same old words"] * 40 + EDGES + oddities
    monkeypatch.setattr(A, "CHUNK_BYTES", chunk)
    want = expected(texts, encoders)
    assert sum(r[1] > 0 for r in want) > 100 and any(t and not r[1] for t, r in zip(texts, want))
    assert answer(A.align_and_count(frame(spark, texts, CLASHING + " n links key"), max_pairs=max_pairs)) == want


def test_cuts_are_offsets_of_groups(encoders):
    for text in ["hello there world", *EDGES]:
        (found,) = A.align_texts([text], A.Vocabularies(), with_cuts=True)
        cuts = np.frombuffer(found[5], "<i8")
        assert len(cuts) == found[2] == len(brute(text, encoders)[2])
        assert not len(cuts) or cuts[-1] == len((" " + text).encode())


def test_long_blanks_are_encoded(encoders):
    text = "x" + " " * 1_200_000 + "y"
    assert V.byte_bpe_ids(" " + text) == encoders[0].encode(" " + text, add_special_tokens=False).ids


def test_repeated_rows_null_ids_and_no_rows(spark, encoders):
    docs = frame(spark, ["one two", None])
    got = answer(A.align_and_count(docs.unionByName(docs)))
    assert got == sorted(expected(["one two", None, "one two", None], encoders)[i][:0] + (i % 2, *expected(["one two", None, "one two", None], encoders)[i][1:]) for i in range(4))
    lone = docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text")
    assert sorted(r.id is None for r in A.align_and_count(lone).collect()) == [True, True]
    assert A.align_and_count(docs.limit(0)).count() == 0
