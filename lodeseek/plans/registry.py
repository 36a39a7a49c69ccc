"""How query modules register what they define."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def put(fn: Query) -> Query:
            key = name or fn.__name__
            self.queries[key] = fn
            if sql is not None:
                self.oracles[key] = sql
            return fn

        return put
