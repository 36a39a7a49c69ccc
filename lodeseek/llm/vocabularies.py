"""Encoders of public vocabulary files, and the bytes that each of their ids stands for."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np

BYTE_BPE, BYTE_BPE_RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
SPACE_MARK = "▁"


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_bpe(path: str, special_as_text: bool):
    """The tokenizers library's own encoder; special_as_text: strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.encode_special_tokens = special_as_text
    return encoder


@lru_cache(maxsize=4)
def rank_bpe(path: str, special: tuple[tuple[str, int], ...] = ()):
    """The same vocabulary as ranks, read by tiktoken: the same ids in a quarter of the time."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def byte_bpe_ids(text: str, special: tuple[tuple[str, int], ...] = (), path: str | None = None, ranks: str | None = None) -> list[int]:
    """Ids of the byte-level BPE. Where special is empty the strings of special tokens are ordinary text.

    tiktoken's pattern matcher gives up on a run of about a million blanks; the tokenizers library, slower, encodes these."""
    try:
        return rank_bpe(ranks or path_of(BYTE_BPE_RANKS), special).encode(text, allowed_special="all", disallowed_special=())
    except ValueError:
        return byte_bpe(path or path_of(BYTE_BPE), not special).encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: printable ones of Latin-1 as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_bpe_bytes(path: str) -> tuple[bytes, ...]:
    letters = byte_of_letter()
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    words = {i: bytes(letters[c] for c in w) for w, i in found["model"]["vocab"].items()}
    words |= {t["id"]: t["content"].encode() for t in found.get("added_tokens", ())}
    return tuple(words.get(i, b"") for i in range(max(words) + 1))


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> tuple[bytes, ...]:
    model = pieces(path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
    return tuple(out)


@lru_cache(maxsize=4)
def decimal_rows(n: int) -> np.ndarray:
    """Row i: the decimal digits of i as ASCII, zero bytes before them."""
    width = len(str(max(n - 1, 1)))
    values, rows = np.arange(n), np.zeros((n, width), dtype=np.uint8)
    for place in range(width):
        shown = (values >= 10**place) | (place == 0)
        rows[:, width - 1 - place] = np.where(shown, 48 + values // 10**place % 10, 0)
    return rows
