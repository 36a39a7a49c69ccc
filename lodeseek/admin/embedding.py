"""Embedders. No model files are at hand offline, so the default hashes tokens: deterministic, unit length, not semantic."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.admin.cache import CacheStats, QueryCache
from lodeseek.admin.errors import ConfigInvalid
from lodeseek.functions.text import STOP_WORDS

_BREAK = re.compile(r"[\s\-_@.,:;!?(){}\[\]<>/\\|\"'`~]+")
#: Dimensions of hosted models, by their services' documentation; others count as 1536.
HOSTED_DIMENSIONS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
    "voyage-2": 1024,
    "voyage-large-2": 1536,
    "voyage-code-2": 1536,
}


class Embedder(Protocol):
    def initialize(self) -> None: ...
    def embed(self, text: str) -> list[float]: ...
    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...
    def dimension(self) -> int: ...
    def dispose(self) -> None: ...


class HashingEmbedder:
    """Signed feature hashing of tokens, scaled to unit length; the dimension is 0 before initialize()."""

    def __init__(self, dimension: int = 384):
        self._wanted, self._ready = dimension, False

    def initialize(self) -> None:
        self._ready = True

    def dispose(self) -> None:
        self._ready = False

    def dimension(self) -> int:
        return self._wanted if self._ready else 0

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if not self._ready:
            raise RuntimeError("initialize() first")
        return [hashed_vector(t, self._wanted).tolist() for t in texts]


def hashed_vector(text: str | None, dimension: int) -> np.ndarray:
    out = np.zeros(dimension)
    for token in _BREAK.split((text or "").lower()):
        if token and token not in STOP_WORDS:
            h = xxhash.xxh64_intdigest(token.encode(), 9)
            out[h % dimension] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out)
    return out / norm if norm else out


class HostedEmbedder:
    """An embedder behind a web service: batches, and waits that double after a refusal. The transport is the caller's,
    (texts, model, key) -> vectors, raising Refused to be tried again; nothing is called unless one is given."""

    class Refused(Exception):
        pass

    def __init__(self, model: str, api_key: str, transport: Callable | None = None, batch: int = 100, tries: int = 3, wait_s: float = 0.1, sleep=time.sleep):
        self.model, self.batch, self.tries, self.wait_s = model, batch, tries, wait_s
        self._key, self._transport, self._sleep, self._ready = api_key, transport, sleep, False

    def initialize(self) -> None:
        key = os.environ.get(m[1], "") if (m := re.fullmatch(r"\$\{(\w+)\}", self._key or "")) else self._key
        if not key:
            raise ConfigInvalid("an API key is required")
        if self._transport is None:
            raise ConfigInvalid("no transport to the service")
        self._key, self._ready = key, True

    def dispose(self) -> None:
        self._ready = False

    def dimension(self) -> int:
        return HOSTED_DIMENSIONS.get(self.model, 1536)

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if not self._ready:
            raise RuntimeError("initialize() first")
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            for attempt in range(self.tries):
                try:
                    out += self._transport(list(texts[i : i + self.batch]), self.model, self._key)
                    break
                except self.Refused:
                    if attempt + 1 == self.tries:
                        raise
                    self._sleep(self.wait_s * 2**attempt)
        return out


class CachedEmbedder:
    """Single queries go through the cache, batches pass it by."""

    def __init__(self, inner: Embedder, cache: QueryCache | None = None):
        self.inner, self.cache = inner, cache or QueryCache()

    def initialize(self) -> None:
        self.inner.initialize()

    def dispose(self) -> None:
        self.cache.clear()
        self.inner.dispose()

    def dimension(self) -> int:
        return self.inner.dimension()

    def embed(self, text: str) -> list[float]:
        found = self.cache.get(text)
        if found is None:
            found = self.inner.embed(text)
            self.cache.set(text, found)
        return found

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return self.inner.embed_batch(texts)

    def stats(self) -> CacheStats:
        return self.cache.stats()


def embed_column(make: Callable[[], Embedder]) -> Callable[[Column], Column]:
    """An Arrow-batched expression; the embedder is made and initialised once per task."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        embedder.initialize()
        for texts in batches:
            yield pd.Series(embedder.embed_batch(texts.fillna("").tolist()), index=texts.index)

    return embed


def embed_documents(chunks: DataFrame, make: Callable[[], Embedder], text_col: str = "text", out_col: str = "vector") -> DataFrame:
    """chunks with a vector each, by the same kind of embedder that embeds queries."""
    return chunks.withColumn(out_col, embed_column(make)(F.col(text_col)))


def with_vectors(chunks: DataFrame, dimension: int = 384, text_col: str = "text", out_col: str = "vector") -> DataFrame:
    return embed_documents(chunks, lambda: HashingEmbedder(dimension), text_col, out_col)
