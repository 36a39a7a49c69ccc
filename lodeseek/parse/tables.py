"""Parsers as table functions: each takes a DataFrame of files and returns a DataFrame of what they hold.

Parsing is Python by nature; it runs in Arrow batches next to the scan, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodeseek.parse import comments as comment_parser
from lodeseek.parse import markdown as markdown_parser
from lodeseek.parse import symbols as symbol_parser
from lodeseek.sources import ini

PARAMS = "array<struct<name:string,type:string,default:string,optional:boolean>>"
MEMBERS = f"array<struct<name:string,type:string,line_start:int,line_end:int,parameters:{PARAMS},return_type:string,value_type:string>>"
SYMBOLS = (
    f"path string, ordinal int, name string, type string, scope string, line_start int, line_end int, parameters {PARAMS}, return_type string, "
    f"extends array<string>, implements array<string>, members {MEMBERS}, value_type string, docstring string, exported boolean, is_async boolean"
)
COMMENTS = (
    "path string, comment_id int, type string, content string, line int, end_line int, marker string, tags array<struct<name:string,value:string,description:string>>"
)
MARKDOWN = "path string, ordinal int, kind string, line int, end_line int, level int, text string, target string, language string"
INI = "path string, section string, key string, values array<string>, line int"


#: Files that are read at once: what they hold is many times as large in Python, so a batch of Spark's is too much.
FILES_AT_ONCE = 64


def _table(files: DataFrame, columns: list[str], rows: Callable[..., list[dict]], schema: str) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                part = batch.slice(at, FILES_AT_ONCE)
                found = [r for values in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))) for r in rows(*values)]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return files.select(*columns).mapInArrow(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """files (path, language, content) -> SYMBOLS rows; files that cannot be read have none."""

    def rows(path, language, content):
        return [{"path": path, "ordinal": n} | s for n, s in enumerate(symbol_parser.extract(content, language)[0])]

    return _table(files, ["path", "language", "content"], rows, SYMBOLS)


def parse_errors(files: DataFrame) -> DataFrame:
    """(path, has_error) for each file."""
    return _table(
        files, ["path", "language", "content"], lambda p, lang, c: [{"path": p, "has_error": symbol_parser.extract(c, lang)[1]}], "path string, has_error boolean"
    )


def comments(files: DataFrame) -> DataFrame:
    def rows(path, language, content):
        return [{"path": path, "comment_id": n} | c for n, c in enumerate(comment_parser.extract(content, language))]

    return _table(files, ["path", "language", "content"], rows, COMMENTS)


def markdown(files: DataFrame) -> DataFrame:
    return _table(files, ["path", "content"], lambda p, c: [{"path": p, "ordinal": n} | x for n, x in enumerate(markdown_parser.parse(c))], MARKDOWN)


def ini_options(files: DataFrame) -> DataFrame:
    """A row per key (values), per environment without keys, and per unexpected line (key 'error', its line)."""

    def rows(path, content):
        config = ini.parse(content)
        sections = [(f"env:{e['name']}", e["options"]) for e in config["environments"]] + ([("common", config["common"])] if config["common"] else [])
        out = [{"path": path, "section": s, "key": k, "values": v, "line": None} for s, options in sections for k, v in (options or {None: []}).items()]
        return out + [{"path": path, "section": None, "key": "error", "values": [e["message"]], "line": e["line"]} for e in config["errors"]]

    return _table(files, ["path", "content"], rows, INI)


def markdown_units(elements: DataFrame) -> DataFrame:
    """Headings and code blocks as chunk symbols (path, ordinal, name, type, scope, docstring, line_start, line_end)."""
    kept = elements.where(F.col("kind").isin("heading", "code"))
    return kept.select(
        "path", "ordinal", F.when(F.col("kind") == "heading", F.col("text")).otherwise(F.coalesce("language", F.lit("code"))).alias("name"),
        F.col("kind").alias("type"), F.lit(None).cast("string").alias("scope"), F.when(F.col("kind") == "code", F.col("text")).alias("docstring"),
        F.col("line").alias("line_start"), F.col("end_line").alias("line_end"),
    )
