from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseek.parse import comments, markdown, symbols
from lodeseek.sources import ignore, ini
from lodeseek.streaming import changes


def test_python_symbols_and_errors():
    found, bad = symbols.extract("class A(B):\n    async def m(self, x: int = 1) -> str: ...\nLIMIT = 3\nname: str = ''\n", "python")
    assert not bad
    assert [(s["name"], s["type"]) for s in found] == [("A", "class"), ("m", "function"), ("LIMIT", "constant"), ("name", "variable")]
    assert found[1]["parameters"] == [{"name": "x", "type": "int", "default": "1", "optional": True}] and found[1]["is_async"]
    assert symbols.extract("def broken(:", "python") == ([], True)
    assert symbols.extract("fn main() {}", "rust") == ([], False) and symbols.extract("  ", "python") == ([], False)


def test_typescript_ignores_strings_and_comments():
    found, _ = symbols.extract("// class No {}\nconst s = 'class Neither {}';\nexport async function f(a, b?: number): Promise<void> {}\n", "typescript")
    assert [s["name"] for s in found] == ["s", "f"]
    assert [(p["name"], p["optional"]) for p in found[1]["parameters"]] == [("a", False), ("b", True)]


@pytest.mark.parametrize("code", ["", "{", "}}}}", "class", "class {", "func (", "export const = ", "/* open", "'unclosed", "enum E", "a" * 5000, "((((" * 100])
@pytest.mark.parametrize("language", ["typescript", "go", "cpp", "python", "c"])
def test_broken_code_does_not_raise(code, language):
    symbols.extract(code, language)
    comments.extract(code, language)


def test_comments():
    found = comments.extract('/** A.\n * @returns x - the y\n */\nint a; // BUG: b\n/* c */\nchar *u = "http://z";', "cpp")
    assert [(c["type"], c["line"], c["end_line"], c["marker"]) for c in found] == [("doc", 1, 3, None), ("line", 4, 4, "BUG"), ("block", 5, 5, None), ("line", 6, 6, None)]
    assert found[0]["tags"] == [{"name": "returns", "value": "x", "description": "the y"}]


def test_markdown_unclosed_fence_and_setext():
    found = markdown.parse("A\n=\n~~~py\nx\n")
    assert [(x["kind"], x["line"], x["level"]) for x in found] == [("heading", 1, 1), ("code", 3, None)]
    assert markdown.parse(None) == [] and markdown.parse("") == []


def test_ini_continuations():
    got = ini.parse("[env:a]\nlib_deps =\n  x\n  y\nbuild_flags = -a -b\nk=1\nk=2\n[other]\nz=1")
    assert got["environments"] == [{"name": "a", "options": {"lib_deps": ["x", "y"], "build_flags": ["-a", "-b"], "k": ["2"]}}] and not got["errors"]


@pytest.mark.parametrize(
    "patterns, path, out",
    [
        (["*.log"], "a/b.log", True), (["/a"], "a/x", True), (["/a"], "b/a", False), (["a/"], "x/a/y", True), (["a/"], "a", False), (["**/t"], "p/q/t", True),
        (["d/**"], "d/x/y", True), (["*.py", "!keep.py"], "keep.py", False), (["!keep.py", "*.py"], "keep.py", True), (["f[ab].c"], "fa.c", True), (["f?.c"], "f/.c", False),
        (["a/**/z"], "a/z", True), (["\\!x"], "!x", True),
    ],
)
def test_ignore_patterns(spark, patterns, path, out):
    assert spark.range(1).select(ignore.excluded(F.lit(path), patterns, defaults=()).alias("x")).first().x is out


def test_change_set_treats_null_digests_as_values(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "path string, digest string")
    new = spark.createDataFrame([("a", "2"), ("b", None), ("d", "4")], "path string, digest string")
    assert {(r.path, r.event) for r in changes.change_set(old, new).collect()} == {("a", "changed"), ("c", "deleted"), ("d", "added")}


def test_queue_keeps_the_latest(spark):
    rows = [("p", 5, 1), ("p", None, 2), ("q", 1, 3)]
    got = changes.drain(changes.queue_items(spark.createDataFrame(rows, "file_path string, priority long, ts long")), 5).collect()
    assert [(r.file_path, r.priority) for r in got] == [("p", 2), ("q", 1)]


def test_parsers_hold_the_rows_of_few_files_at_once(spark):
    """A batch of Spark's has up to 10,000 files; rows leave the parser long before all of these are read."""
    from lodeseek.parse import tables

    def rows(path):
        assert int(path) < 3 * tables.FILES_AT_ONCE, "read ahead of what was asked for"
        return [{"path": path}]

    kept = {}

    class Files:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            kept["run"] = run

    tables._table(Files(), ["path"], rows, "path string")
    out = kept["run"](iter([pa.RecordBatch.from_pydict({"path": [str(i) for i in range(10_000)]})]))
    first = [next(out), next(out)]
    assert [b.num_rows for b in first] == [tables.FILES_AT_ONCE] * 2 and first[1].column(0)[0].as_py() == str(tables.FILES_AT_ONCE)
