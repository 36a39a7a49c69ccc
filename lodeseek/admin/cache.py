"""The driver's cache of query embeddings: least recently used, with a time to live that reads refresh."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class CacheStats:
    hits: int
    misses: int
    hit_rate: float
    size: int
    max_size: int


class QueryCache:
    def __init__(self, max_size: int = 1000, ttl_s: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.max_size, self.ttl_s, self._clock = max_size, ttl_s, clock
        self._items: OrderedDict[str, tuple[float, list[float]]] = OrderedDict()
        self._hits = self._misses = 0

    @staticmethod
    def key(query: str) -> str:
        return query.strip().lower()

    def _live(self, query: str) -> list[float] | None:
        key = self.key(query)
        item = self._items.get(key)
        if item is None or self._clock() - item[0] > self.ttl_s:
            self._items.pop(key, None)
            return None
        self._items[key] = (self._clock(), item[1])
        self._items.move_to_end(key)
        return item[1]

    def get(self, query: str) -> list[float] | None:
        value = self._live(query)
        if value is None:
            self._misses += 1
        else:
            self._hits += 1
        return value

    def set(self, query: str, vector: Sequence[float]) -> None:
        self._items[self.key(query)] = (self._clock(), list(vector))
        self._items.move_to_end(self.key(query))
        while len(self._items) > self.max_size:
            self._items.popitem(last=False)

    def has(self, query: str) -> bool:
        return self._live(query) is not None

    def clear(self) -> None:
        self._items.clear()
        self.reset_stats()

    def reset_stats(self) -> None:
        self._hits = self._misses = 0

    def stats(self) -> CacheStats:
        asked = self._hits + self._misses
        return CacheStats(self._hits, self._misses, self._hits / asked if asked else 0.0, len(self._items), self.max_size)
