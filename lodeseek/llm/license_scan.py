"""License scanning by diagonal voting, with DataFrame functions only.

Templates are phrases and passages of licenses as words. Every rolling k-gram of words of every text is
hashed and joined with the templates' (phrases by pairs, passages by k words); a hit at word p of the text and word t
of a template votes for the diagonal p - t. A phrase stands where its diagonal has all its votes. For a passage
neighbouring diagonals (an inserted or lost word shifts the rest by one) are merged, and the merged span is verified:
enough distinct places of the template, in about the template's length.

Places that were hit are bits of 64 at a time, so votes are joined by OR and no list of them is ever collected, however
often a text repeats a passage. The template table is broadcast once its size is known to be within bounds; nothing else
is. Each text adds one row of its own, so texts without a hit need no second scan, and votes are aggregated before the
shuffle: what moves is a row per text, template, diagonal and 64 places.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    is_phrase: bool

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(SEPARATORS, self.text.lower()) if w]


PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

#: Opening passages of public licenses.
PASSAGES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", False),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", False),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", False),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", False),
)
TEMPLATES = PHRASES + PASSAGES
MAX_TEMPLATE_WORDS = 100_000

MIN_COVERAGE = 0.6
MERGE_GAP = 3
MAX_STRETCH = 1.5


def grams(t: Template, k: int) -> int:
    """The length of a template's grams: pairs of a phrase, k words of a passage."""
    return 2 if t.is_phrase else k


def template_grams(templates: Sequence[Template], k: int) -> list[tuple]:
    """(template, place, gram length, words..., null up to the longest)."""
    most = max(2, k)
    out = []
    for n, t in enumerate(templates):
        size, words = grams(t, k), t.words
        out += [(n, i, size, *words[i : i + size], *[None] * (most - size)) for i in range(len(words) - size + 1)]
    return out


def templates_of(table: DataFrame) -> tuple[Template, ...]:
    """Templates kept as a table (label, text, is_phrase), read in full once their words are known to be within MAX_TEMPLATE_WORDS."""
    rows = table.select("label", "text", "is_phrase").na.drop().distinct()
    if (rows.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast")
    return tuple(Template(r.label, r.text, r.is_phrase) for r in rows.orderBy("label", "is_phrase", "text").collect())


def literal_table(spark: SparkSession, rows: Sequence[tuple], fields: str) -> DataFrame:
    """A small table that the JVM reads from a literal: createDataFrame would unpickle its rows in Python workers."""
    names = [f.split(":")[0] for f in fields.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, k: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    Templates shorter than their grams are not searched. score is 1 with a phrase, else the largest verified or unverified
    share of a passage's places. Null and empty texts have no words. Repeated rows return a row each; an empty table none. Of
    diagonals that tie nothing is dropped: each merged span counts. Very long texts are searched whole. Other columns of
    docs, whatever their names, are not read."""
    spark = docs.sparkSession
    found = template_grams(templates, k)
    if len(found) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast")
    sizes, most = sorted({2, k}), max(2, k)
    names = [f"t{i}" for i in range(most)]
    about = literal_table(
        spark, [(n, t.label, t.is_phrase, len(t.words) - grams(t, k) + 1) for n, t in enumerate(templates)], "tpl:int,label:string,is_phrase:boolean,places:int"
    )
    own_row = (-1, 0, sizes[0], *[None] * most)
    table = literal_table(spark, [*found, own_row], "tpl:int,place:int,k:int," + ",".join(f"{n}:string" for n in names))
    hashed = F.lit(0).cast("long")
    for size in sizes:
        hashed = F.when((F.col("k") == size) & (F.col("tpl") >= 0), F.xxhash64(F.lit(size), *names[:size])).otherwise(hashed)
    table = table.withColumn("h", hashed).drop("k")

    raw, size = F.col("_w"), F.size("_w")
    blank_first = (raw[0] == "").cast("int")
    blank_last = (F.element_at(raw, -1) == "").cast("int")
    own = F.col("p") == F.col("_n")
    # Lower case changes no separator into a word or back, and makes no phrase's letters out of others but A-Z.
    rows = (
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(id_col).cast("long").alias("id"),
            F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS).alias("_w"),
        )
        .withColumn("_b", blank_first)
        .withColumn("_n", F.greatest(F.lit(0), size - blank_first - blank_last))
        .select("uid", "id", "_w", "_b", "_n", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("p"))
        .select("uid", "id", "p", own.alias("own"), *(F.get("_w", F.col("_b") + F.col("p") + i).alias(f"w{i}") for i in range(most)))
    )
    hits = None
    for size in sizes:
        h = F.xxhash64(F.lit(size), *(f"w{i}" for i in range(size)))
        part = rows.withColumn("h", F.when(F.col("own"), F.lit(0).cast("long")).otherwise(h) if size == sizes[0] else h)
        alike = ~F.col("own")
        for i in range(size):
            alike = alike & (F.col(f"w{i}") == F.col(f"t{i}"))
        if size < most:
            alike = alike & F.col(f"t{size}").isNull()
        part = part.join(F.broadcast(table), "h").where(F.when(F.col("tpl") < 0, F.col("own") & F.lit(size == sizes[0])).otherwise(alike))
        hits = part if hits is None else hits.unionByName(part)
    bit = F.expr("shiftleft(1L, place % 64)")
    diagonals = hits.groupBy("uid", "id", "tpl", (F.col("p") - F.col("place")).alias("diagonal"), F.expr("place DIV 64").alias("part")).agg(
        F.min("p").alias("lo"), F.max("p").alias("hi"), F.bit_or(bit).alias("bits")
    )
    diagonals = diagonals.join(F.broadcast(about), "tpl", "left")

    by_place = Window.partitionBy("uid", "tpl").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal", 1).over(by_place)
    runs = diagonals.withColumn("new", (F.when(F.col("is_phrase"), apart > 0).otherwise(apart > MERGE_GAP)).cast("int")).withColumn(
        "run", F.sum(F.coalesce("new", F.lit(0))).over(by_place)
    )
    keys = ["uid", "id", "tpl", "label", "is_phrase", "places", "run"]
    ends = (F.min("diagonal").alias("start"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    grouped = runs.groupBy(*keys, "part").agg(*ends, F.bit_or("bits").alias("bits"))
    ends = (F.min("start").alias("start"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    grouped = grouped.groupBy(*keys).agg(*ends, F.sum(F.bit_count("bits")).alias("votes"))
    share = F.col("votes") / F.col("places")
    whole = F.col("is_phrase") & (F.col("votes") == F.col("places"))
    verified = ~F.col("is_phrase") & (share >= MIN_COVERAGE) & (F.col("hi") - F.col("lo") + 1 <= MAX_STRETCH * F.col("places"))

    def listed(cond: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")

    return (
        grouped.groupBy("uid", "id")
        .agg(
            F.max(F.when(F.col("tpl") < 0, F.col("hi"))).cast("long").alias("n_words"),
            F.sum(F.when(whole, 1).otherwise(0)).cast("long").alias("n_base"),
            F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"),
            listed(whole).alias("base_labels"),
            listed(whole | verified).alias("labels"),
            F.coalesce(F.max(F.when(whole, F.lit(1.0)).when(~F.col("is_phrase"), F.least(share, F.lit(1.0)))), F.lit(0.0)).alias("score"),
        )
        .drop("uid")
    )


def oracle_sql(templates: Sequence[Template] = TEMPLATES) -> str:
    """The same result in DuckDB's SQL, from word lists instead of hashes."""
    pairs = ", ".join(f"({n}, {i}, '{a}', '{b}')" for n, i, _, a, b in template_grams(templates, 2))
    about = ", ".join(f"({n}, '{t.label}', {str(t.is_phrase).lower()}, {len(t.words) - 1})" for n, t in enumerate(templates))
    return f"""
WITH pairs(tpl, place, t1, t2) AS (VALUES {pairs}),
about(tpl, label, is_phrase, places) AS (VALUES {about}),
texts AS (
  SELECT row_number() OVER () AS uid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws
  FROM documents),
places AS (SELECT uid, ws, unnest(range(1, len(ws))) AS p FROM texts),
hits AS (
  SELECT uid, tpl, p - 1 - place AS diagonal, p - 1 AS p, place
  FROM places JOIN pairs ON ws[p] = t1 AND ws[p + 1] = t2),
diagonals AS (SELECT uid, tpl, diagonal, min(p) AS lo, max(p) AS hi FROM hits GROUP BY ALL),
flagged AS (
  SELECT d.*, label, is_phrase, places,
         CASE WHEN is_phrase OR diagonal - lag(diagonal) OVER w > {MERGE_GAP} THEN 1 ELSE 0 END AS fresh
  FROM diagonals d JOIN about USING (tpl) WINDOW w AS (PARTITION BY uid, tpl ORDER BY diagonal)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY uid, tpl ORDER BY diagonal) AS run FROM flagged),
grouped AS (
  SELECT r.uid, r.tpl, r.label, r.is_phrase, r.places, r.run, min(r.diagonal) AS start, min(r.lo) AS lo, max(r.hi) AS hi,
         count(DISTINCT h.place) AS votes
  FROM runs r JOIN hits h ON h.uid = r.uid AND h.tpl = r.tpl AND h.diagonal = r.diagonal GROUP BY ALL),
judged AS (
  SELECT *, is_phrase AND votes = places AS whole,
         NOT is_phrase AND votes / places >= {MIN_COVERAGE} AND hi - lo + 1 <= {MAX_STRETCH} * places AS verified
  FROM grouped),
summed AS (
  SELECT uid, count(*) FILTER (WHERE whole) AS n_base, min(start) FILTER (WHERE whole) AS first_word,
         max(start) FILTER (WHERE whole) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole OR verified) AS labels,
         max(CASE WHEN whole THEN 1.0::DOUBLE WHEN NOT is_phrase THEN least(votes / places, 1.0::DOUBLE) END) AS score
  FROM judged GROUP BY uid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts LEFT JOIN summed USING (uid)
"""
