from __future__ import annotations

import json

import pytest

from lodeseek.admin.errors import InvalidParams
from lodeseek.plans import fixtures
from lodeseek.service import Engine, checked, input_schema


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, _, content in fixtures.FILES:
        target = root / path.removeprefix("/work/")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    (root / "node_modules").mkdir()
    (root / "node_modules/x.js").write_text("function hidden() {}")
    (root / "skip.py").write_text("def skipped(): pass")
    (root / ".gitignore").write_text("skip.py\n")
    out = Engine(spark, f"file://{tmp_path_factory.mktemp('index')}")
    out.project = str(root)
    out.answer = out.index_project(rootPath=str(root))
    return out


def test_index(engine):
    assert engine.answer["success"] and engine.answer["stats"]["indexedFiles"] == 7 and engine.answer["stats"]["failedFiles"] == 0
    names = {r.name for r in engine.store.read("chunks").select("name").collect()}
    assert {"Square", "mean", "Point", "Lamp", "Measuring"} <= names and not {"hidden", "skipped"} & names


def test_search(engine):
    got = engine.search_code(query="mean of rows", topK=3)
    assert got["totalResults"] == 3 and got["results"][0]["name"] == "mean" and "def mean" in got["results"][0]["snippet"]
    only = engine.search_code(query="mean of rows", languages=["Python"])
    assert {r["language"] for r in only["results"]} == {"python"}
    assert engine.search_code(query="  x ", topK=1)["totalResults"] <= 1


def test_symbols(engine):
    got = engine.get_symbol(symbolName="Point")
    assert [d["line_start"] for d in got["definitions"]] == [4]
    assert [(r["line"], r["column"]) for r in got["references"]] == [(3, 3), (4, 5), (8, 9)]


def test_related(engine):
    got = engine.find_related_docs(filePath="src/shapes.ts")
    assert got["documents"][0]["doc_path"].endswith("README.md") and got["documents"][0]["relevance"] == 1.0
    assert {m["kind"] for m in got["documents"][0]["matches"]} == {"path", "symbol", "code"}
    with pytest.raises(InvalidParams):
        engine.find_related_docs()


def test_status_update_and_clear(engine, spark):
    assert [p["total_files"] for p in engine.get_index_status()["projects"]] == [7]
    path = next(r.file_path for r in engine.store.read("files").where("file_path LIKE '%stats.py'").collect())
    before = engine.store.read("chunks")
    engine.update_files(engine.project, spark.createDataFrame([(path, "python", "code", "def fresh(): pass\n")], "path string, language string, kind string, content string"))
    assert {d["file_path"] for d in engine.get_symbol(symbolName="fresh")["definitions"]} == {path}
    assert engine.get_symbol(symbolName="mean")["definitions"] == []
    assert before.where("name = 'mean'").count() == 1  # the snapshot that was opened stays readable
    with pytest.raises(InvalidParams):
        engine.clear_index()
    assert engine.clear_index(confirm=True, projectId=engine.project)["clearedProjects"] == [engine.project]
    assert engine.search_code(query="fresh")["totalResults"] == 0


def test_health_and_errors(engine):
    assert engine.health_check()["status"] == "healthy"
    text, is_error = engine.call("nothing")
    assert is_error and json.loads(text)["code"] == -32601
    text, is_error = engine.call("get_symbol", {"symbolName": 3})
    assert is_error and json.loads(text)["code"] == -32602
    assert input_schema("search_code")["required"] == ["query"] and checked("search_code", {"query": "x"})["topK"] == 10
