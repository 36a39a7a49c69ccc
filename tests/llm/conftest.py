from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "s", "v") for c in ("a", "el", "ik", "or")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, extra: str = ""):
    """Documents 0.. of these texts; extra adds columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else "fr", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in extra.split():
            df = df.withColumn(name, F.lit("x"))
    return df


CLASHING = "id uid _t g sub w fp key bucket rank shard score label h tpl part count size component"


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def oddities():
    """Null, empty, blank, repeated, one word, unusual characters, very long."""
    long = " ".join(f"w{i % 997} v{i % 13}" for i in range(30_000))
    return [None, "", "   \n\t", "word", "word", "Ünïcödé 日本語 \U0001f600 x", "a\x00b", "x" * 50_000, long, long, "İK ſ"]


def rows(df) -> list[Row]:
    return df.collect()
