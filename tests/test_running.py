"""Scans, watchers, the update queue, plugins, modes, syntax nodes and small changes of an index."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lodeseek.admin import config, status, telemetry
from lodeseek.admin.embedding import HashingEmbedder, HostedEmbedder
from lodeseek.admin.errors import ConfigInvalid
from lodeseek.admin.modes import Modes, hosted_embedder, make_embedder
from lodeseek.parse import nodes
from lodeseek.service import Engine
from lodeseek.sources import ignore, languages, plugins, scan
from lodeseek.sources.store import MAX_PARTS, Store
from lodeseek.streaming import changes
from lodeseek.streaming.queue import UpdateQueue
from lodeseek.streaming.watcher import Watcher, WatchOptions, as_table, differences, snapshot


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project [1]"
    for name, content in {
        "pkg/__init__.py": b"A = 1\n", "pkg/odd*name.py": b"b = 2\n", ".hidden.js": b"let c = 3;\n", ".config/tool.ts": b"let d = 4;\n", "latin.py": b"# caf\xe9\ne = 5\n",
        "node_modules/m/i.js": b"x", "deep/node_modules/m/i.js": b"x", "build/keep.py": b"x", "notes.txt": b"x", "skip/s.py": b"x", "platformio.ini": b"[env:a]\n",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (root / ".gitignore").write_text("skip/\n!skip/s.py\n")
    return root


def test_scan_lists_hidden_files_and_survives_bad_bytes(spark, tree):
    heard = []
    rows = {r.rel_path: r for r in scan.scan(spark, str(tree), on_event=lambda *e: heard.append(e)).collect()}
    assert set(rows) == {"pkg/__init__.py", "pkg/odd*name.py", ".hidden.js", ".config/tool.ts", "latin.py", "platformio.ini", "deep/node_modules/m/i.js"}
    assert rows["latin.py"].content == "# caf\ufffd\ne = 5\n" and not rows["latin.py"].valid and rows["pkg/__init__.py"].valid
    assert rows["pkg/__init__.py"].content == "A = 1\n" and rows[".hidden.js"].size == 11 and rows[".hidden.js"].language == "javascript"
    entered = {p for e, p in heard if e == "directoryEntered"}
    assert "node_modules" not in entered and "skip" not in entered and "build" not in entered and "pkg" in entered
    assert {p for e, p in heard if e == "fileScanned"} == set(rows) and heard[-1] == ("scanComplete", "")
    stats = scan.scan_stats(scan.list_files(spark, str(tree)), spark).first()
    assert stats.total_files == 7 and stats.excluded_files == 2
    assert scan.scan(spark, str(tree), scan.ScanOptions(extensions=[".zig"])).count() == 1
    with pytest.raises(Exception, match="not exist"):
        scan.scan(spark, str(tree / "missing"))
    with pytest.raises(ValueError):
        scan.scan(spark, str(tree), scan.ScanOptions(max_hidden_bytes=3))


def test_matcher_says_what_the_column_says(spark):
    rng = random.Random(5)
    parts = ["a", "b", "dist", "node_modules", "x.py", "k.pem", ".env", ".env.local", "build"]
    paths = ["/".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(200)]
    layers = [["a/", "!a/x.py", "*.pem"], ["/b/*", "**/x.py"]]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.x for r in df.select("path", ignore.excluded(F.col("path"), *layers).alias("x")).collect()}
    test, prune = ignore.matcher(*layers), ignore.pruner(*layers)
    assert all(test(p) == got[p] for p in paths)
    for p in paths:  # nothing below a pruned folder is kept, but for what a negation below an excluded folder says
        folder = p.rpartition("/")[0]
        if folder and prune(folder) and "a/" not in folder + "/":
            assert got[p], p
    wanted = {r.path: r.x for r in df.select("path", languages.is_scanned(F.col("path")).alias("x")).collect()}
    assert all(languages.is_scanned_path(p) == wanted[p] for p in paths)


def test_watcher_reports_settled_changes_once(spark, tree):
    now = [0.0]
    heard = []
    watcher = Watcher(spark, str(tree), WatchOptions(), clock=lambda: now[0])
    for event in ("added", "changed", "deleted"):
        watcher.on(event, lambda path, event=event: heard.append((event, path)))
    watcher.once("ready", lambda: heard.append("ready"))

    def rounds(n=12, step=0.1):
        for _ in range(n):
            now[0] += step
            watcher.poll()

    rounds(2)
    assert heard == ["ready"]
    (tree / "new.py").write_text("n = 1\n")
    (tree / "latin.py").write_text("changed = 1\n")
    (tree / "pkg/__init__.py").unlink()
    (tree / "noise.log").write_text("x")
    (tree / "node_modules/m/j.js").write_text("x")
    now[0] += 0.05
    watcher.poll()
    assert heard == ["ready"]
    rounds()
    assert sorted(heard[1:]) == [("added", "new.py"), ("changed", "latin.py"), ("deleted", "pkg/__init__.py")]
    rounds()
    assert len(heard) == 4
    for n in range(8):  # a file that keeps growing waits
        (tree / "new.py").write_text("n" * (n + 10))
        now[0] += 0.06
        watcher.poll()
    assert len(heard) == 4
    rounds()
    assert heard[4:] == [("changed", "new.py")]
    with pytest.raises(ValueError):
        Watcher(spark, "  ")


def test_watcher_and_table_differences_agree(spark, tree):
    before = snapshot(spark, str(tree))
    assert "node_modules/m/i.js" not in before and "notes.txt" in before
    (tree / "notes.txt").unlink()
    (tree / "other.txt").write_text("yy")
    after = snapshot(spark, str(tree))
    by_table = {(r.event, r.path) for r in changes.change_set(as_table(spark, before), as_table(spark, after)).collect()}
    assert by_table == set(differences(before, after)) == {("deleted", "notes.txt"), ("added", "other.txt")}


def test_watcher_thread(spark, tree):
    heard = []
    watcher = Watcher(spark, str(tree), WatchOptions(debounce_s=0.05, stable_s=0.01, poll_s=0.02)).on("added", heard.append)
    assert not watcher.is_watching()
    watcher.start()
    watcher.start()
    assert watcher.is_watching()
    (tree / "late.py").write_text("x = 1\n")
    until = time.time() + 20
    while not heard and time.time() < until:
        time.sleep(0.05)
    watcher.stop()
    watcher.stop()
    assert heard == ["late.py"] and not watcher.is_watching()
    with pytest.raises(Exception, match="not exist"):
        Watcher(spark, str(tree / "missing")).start()


def test_queue_order_errors_and_control():
    done, now = [], [0.0]

    def update(path, project):
        done.append((path, project))
        if path == "bad":
            raise RuntimeError("cannot read")

    def clock():
        now[0] += 1
        return now[0]

    queue = UpdateQueue(update, interval_s=0.01, clock=clock)
    queue.enqueue("old", "p")
    queue.enqueue("low", "p", 0)
    queue.enqueue("bad", "p", 1000)
    queue.enqueue("old", "q")
    queue.enqueue("tie1", "p", 500)
    queue.enqueue("tie2", "p", 500)
    assert queue.stats() == {"queueSize": 5, "isProcessing": False, "processedCount": 0, "failedCount": 0}
    while queue.step():
        pass
    assert done == [("bad", "p"), ("tie2", "p"), ("tie1", "p"), ("old", "q"), ("low", "p")]
    assert queue.processed == 5 and queue.failed == [("bad", "cannot read")]
    queue.enqueue("x", "p")
    queue.clear()
    assert not queue.step()
    queue.start()
    queue.start()
    assert queue.stats()["isProcessing"]
    queue.enqueue("y", "p")
    until = time.time() + 10
    while queue.processed < 6 and time.time() < until:
        time.sleep(0.01)
    queue.stop()
    queue.stop()
    assert done[-1] == ("y", "p") and not queue.stats()["isProcessing"]


def test_queue_agrees_with_the_table(spark):
    rng = random.Random(2)
    rows = [(f"f{rng.randrange(8)}", rng.choice([None, 1, 2, 3]), t) for t in range(1, 30)]
    queue = UpdateQueue(lambda p, q: None, clock=iter(range(1, 99)).__next__)
    for path, priority, _ in rows:
        queue.enqueue(path, "p", priority)
    table = spark.createDataFrame([(p, None if q is None else q, t) for p, q, t in rows], "file_path string, priority long, n int").withColumn("ts", F.timestamp_seconds("n"))
    want = [r.file_path for r in changes.drain(changes.queue_items(table), 99).collect()]
    got = []
    while (item := queue.next()) is not None:
        got.append(item.file_path)
    assert got == want


def test_plugins(spark, tmp_path):
    registry = plugins.default_registry(spark)
    assert registry.list() == ["parquet"] and registry.has("parquet")
    with pytest.raises(ValueError):
        registry.register(plugins.ParquetVectors(spark))
    with pytest.raises(KeyError):
        registry.get("other")
    registry.unregister("other")
    store = registry.get("parquet")
    with pytest.raises(ConnectionError):
        store.stats("c")
    settings = {"vectorStore": {"backend": "parquet", "config": {"path": f"file://{tmp_path}/vectors"}}}
    assert plugins.make_store(settings, registry) is store
    with pytest.raises(ConfigInvalid):
        plugins.make_store({"vectorStore": {"backend": "far"}}, registry)
    store.create_collection("c", 2)
    with pytest.raises(ValueError):
        store.create_collection("c", 2)
    rows = spark.createDataFrame([("a", [0.0, 0.0], "go"), ("b", [1.0, 0.0], "go"), ("c", [3.0, 0.0], "py")], "id string, vector array<double>, language string")
    store.upsert("c", rows)
    store.upsert("c", rows.where("id = 'a'").withColumn("vector", F.array(F.lit(9.0), F.lit(0.0))))
    assert [r.id for r in store.query("c", [0.0, 0.0], 2).collect()] == ["b", "c"]
    assert [r.id for r in store.query("c", [0.0, 0.0], 2, {"language": ["go"]}).collect()] == ["b", "a"]
    store.delete("c", ["b", "nobody"])
    assert store.stats("c") == {"vectorCount": 2, "dimension": 2, "indexSize": 16}
    with pytest.raises(KeyError):
        store.query("d", [0.0], 1)
    store.delete_collection("c")
    store.delete_collection("c")
    store.disconnect()
    with pytest.raises(ConnectionError):
        store.query("c", [0.0], 1)


def test_retry_waits_longer_each_time():
    waits, tries = [], []

    def fails():
        tries.append(1)
        if len(tries) < 4:
            raise OSError("down")
        return "up"

    assert plugins.with_retry(fails, "connect", sleep=waits.append) == "up" and waits == [1.0, 2.0, 4.0]
    assert plugins.Backoff(retries=6).waits() == [1.0, 2.0, 4.0, 8.0, 10.0, 10.0]
    with pytest.raises(ConnectionError, match="failed 4 times: always"):
        plugins.with_retry(lambda: (_ for _ in ()).throw(OSError("always")), "connect", sleep=waits.append)


def test_modes_select_the_embedder():
    local = Modes(config.DEFAULTS)
    assert local.is_local() and not local.is_cloud() and local.blocks_external_calls() and local.warnings() == []
    with pytest.raises(RuntimeError):
        local.embedder
    assert local.start().dimension() == 384 and local.embedder is not None
    local.dispose()
    with pytest.raises(RuntimeError):
        local.embedder
    with pytest.raises(ConfigInvalid):
        Modes().mode
    cloud = config.merged(config.DEFAULTS, {"mode": "cloud", "embedding": {"provider": "voyageai", "model": "voyage-2", "apiKey": "k"}, "privacy": {"blockExternalCalls": False}})
    factory = hosted_embedder(lambda texts, model, key: [[float(len(t)), 1.0] for t in texts])
    embedder = Modes(cloud).start(hosted=factory)
    assert embedder.dimension() == 1024 and embedder.embed("abc") == [3.0, 1.0]
    for change in ({"embedding": {"apiKey": ""}}, {"embedding": {"provider": "other"}}, {"mode": "local", "privacy": {"blockExternalCalls": True}}):
        with pytest.raises(ConfigInvalid):
            make_embedder(config.merged(cloud, change), hosted=factory)
    with pytest.raises(ConfigInvalid):
        make_embedder(cloud)


def test_health_probes_have_a_time_limit():
    checker = status.HealthChecker("1", lambda: time.sleep(5), lambda: [1.0], timeout_s=0.1)
    found = checker.check()
    assert found["status"] == "degraded" and "no answer" in found["dependencies"]["vector_store"]["error"]


def test_metrics_and_exporters(capsys):
    silent = telemetry.Metrics()
    silent.request("t")
    assert silent.memory_mb() is None
    own = telemetry.Telemetry(True, 1.0, telemetry.exporter("console"))
    m = telemetry.setup(own)
    assert telemetry.metrics() is m
    m.request("search_code")
    m.request("search_code")
    m.error("search_code", "-32602")
    m.store_operation("upsert")
    m.duration(2.0)
    m.duration(4.0)
    m.results(3)
    m.index(7, 11)
    assert m.memory_mb() > 1
    found = own.read()
    assert found["counters"][(m.REQUESTS, ("tool", "search_code"))] == 2 and found["histograms"][m.DURATION] == {"count": 2, "sum": 6.0, "min": 2.0, "max": 4.0}
    assert found["gauges"][m.FILES] == 7 and found["gauges"][m.SYMBOLS] == 11
    with own.span("step", apiKey="x"):
        pass
    assert '"name": "step"' in capsys.readouterr().err
    telemetry.setup(None)
    sent = []
    telemetry.exporter("otlp", sent.append)(telemetry.Span("a", "1", "2"))
    assert sent[0]["traceId"] == "1" and telemetry.exporter("none") is None
    with pytest.raises(ValueError):
        telemetry.exporter("other")
    with pytest.raises(ValueError):
        telemetry.Telemetry.from_config({"telemetry": {"samplingRate": 2}}, {})


PY = "def f(a):\n    é = 'ü'; return a\n\nclass C:\n    x = 1\n"
TS = "function f(a: number) {\n  // note }\n  return [a, '}'];\n}\n"


def test_python_nodes():
    tree = nodes.tree_of(PY, "python")
    kinds = [n["type"] for n in tree]
    assert kinds[0] == "module" and kinds.count("function_def") == 1 and kinds.count("class_def") == 1
    found = next(n for n in tree if n["type"] == "return")
    assert (found["start_row"], found["start_col"], found["end_row"], found["end_col"]) == (1, 13, 1, 21)
    assert all(n["parent_id"] is None or n["parent_id"] < n["node_id"] and tree[n["parent_id"]]["depth"] == n["depth"] - 1 for n in tree)
    broken = nodes.tree_of("x = 1\ndef (:\n", "python")
    assert [(n["type"], n["has_error"]) for n in broken] == [("module", True), ("ERROR", True)] and broken[1]["start_row"] == 1
    assert nodes.tree_of("x", "cobol") == [] and nodes.tree_of(None, "python") == []


def test_bracket_nodes_and_errors():
    tree = nodes.tree_of(TS, "typescript")
    assert [n["type"] for n in tree] == ["program", "group", "block", "comment", "list", "string"] and not tree[0]["has_error"]
    assert [n["depth"] for n in tree] == [0, 1, 1, 2, 2, 3] and (tree[2]["end_row"], tree[2]["end_col"]) == (3, 1)
    for code, bad in (("f(a { b }", 1), ("a)", 1), ("{[}", 1), ("{", 1), ("{}", 0)):
        tree = nodes.tree_of(code, "go")
        assert sum(n["type"] == "ERROR" for n in tree) == bad and tree[0]["has_error"] == bool(bad), code


def test_node_tables(spark):
    files = spark.createDataFrame([("a.py", "python", PY), ("b.ts", "typescript", TS), ("c.ts", "typescript", "f(")], "path string, language string, content string")
    tree = nodes.nodes(files)
    assert nodes.of_types(tree, ["block", "class_def"]).count() == 2
    assert {r.path for r in nodes.errors(tree).collect()} == {"c.ts"} and {r.path for r in nodes.traverse(tree, skip_errors=True).collect()} == {"a.py", "b.ts"}
    assert nodes.traverse(tree, max_depth=0).count() == 3
    places = spark.createDataFrame([("b.ts", 2, 13), ("b.ts", 3, 1), ("b.ts", 0, 10), ("a.py", 4, 4), ("a.py", 90, 0)], "path string, row int, col int")
    got = {(r.path, r.row, r.col): r.type for r in nodes.at_positions(tree, places).collect()}
    assert got == {("b.ts", 2, 13): "string", ("b.ts", 3, 1): "program", ("b.ts", 0, 10): "group", ("a.py", 4, 4): "name", ("a.py", 90, 0): None}
    texts = {(r.path, r.type): r.t for r in tree.join(files, "path").select("path", "type", nodes.text(F.col("content")).alias("t")).collect()}
    assert texts[("b.ts", "group")] == "(a: number)" and texts[("b.ts", "block")] == TS[TS.index("{") : -1]
    assert texts[("a.py", "class_def")] == "class C:\n    x = 1" and texts[("a.py", "function_def")].endswith("return a")
    one = nodes.child_counts(tree.where("path = 'b.ts'")).collect()
    assert {r.node_id: (r.children, r.ordinal) for r in one}[0] == (2, 0) and {r.node_id: (r.children, r.ordinal) for r in one}[4] == (1, 1)


def test_store_writes_only_what_changes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("t", spark.range(1000).selectExpr("id", "id AS v"))
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "s").rglob("*.parquet"))
    first = size()
    state = {i: i for i in range(1000)}
    opened = store.read("t")
    for step in range(MAX_PARTS + 3):
        rows = spark.createDataFrame([(step, -step), (2000 + step, step)], "id long, v long")
        store.change("t", rows, rows.select("id").union(spark.createDataFrame([(500 + step,)], "id long")), ["id"])
        state.pop(500 + step, None)
        state |= {step: -step, 2000 + step: step}
        if step == 1:
            assert size() < 2 * first + 20_000 and opened.count() == 1000
    assert {r.id: r.v for r in store.read("t").collect()} == state
    assert len(store._names(f"{store.root}/t/_versions")) <= store.keep + 1
    store.delete("t", spark.createDataFrame([(3,), (99999,)], "id long"))
    assert store.read("t").count() == len(state) - 1


class Doubled:
    """An embedder that is not the default one."""

    def initialize(self): ...
    def dispose(self): ...
    def dimension(self):
        return 2

    def embed(self, text):
        return self.embed_batch([text])[0]

    def embed_batch(self, texts):
        return [[float(len(t)), float(t.count("e"))] for t in texts]


def test_engine_uses_one_embedder_and_updates_files(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    for i in range(6):
        (root / f"m{i}.py").write_text(f"def one{i}(rows):\n    return rows\n\n\ndef two{i}(x):\n    return x\n")
    engine = Engine(spark, f"file://{tmp_path}/index", embedder=Doubled())
    project = str(root)
    assert engine.index_project(rootPath=project)["stats"]["totalSymbols"] == 12
    units = engine.store.read("chunks").select("text", "vector").collect()
    assert all(list(r.vector) == Doubled().embed(r.text) for r in units)
    names = lambda: sorted(r.name for r in engine.store.read("chunks").select("name").collect())
    terms = lambda: {r.term for r in engine.store.read("postings").select("term").distinct().collect()}
    (root / "m0.py").write_text("def fresh(y):\n    return y\n")
    engine.update_file(str(root / "m0.py"), project)
    assert "fresh" in names() and "one0" not in names() and "one1" in names()
    assert "fresh" in terms() and "one0" not in terms() and engine.store.read("doc_stats").count() == len(names())
    (root / "m1.py").unlink()
    engine.update_file(str(root / "m1.py"), project)
    engine.remove_file(str(root / "m2.py"), project)
    engine.remove_file("nowhere.py", project)
    assert not {"one1", "two1", "one2"} & set(names()) and len(names()) == 7 and not {"one1", "one2"} & terms()
    assert engine.search_code(query="fresh", topK=1)["results"][0]["name"] == "fresh"
    assert engine.index_project(rootPath=project)["stats"]["totalSymbols"] == 9 and len(names()) == 9
    engine.enable_watching(project, WatchOptions(debounce_s=0.05, stable_s=0.01, poll_s=0.02))
    (root / "m3.py").write_text("def seen(z):\n    return z\n")
    until = time.time() + 60
    while "seen" not in names() and time.time() < until:
        time.sleep(0.2)
    assert engine.watching()[project]["isProcessing"]
    engine.shutdown()
    engine.shutdown()
    assert "seen" in names() and "one3" not in names() and engine.watching() == {}
    answer = engine.get_symbol(symbolName="seen", max_references=1)
    assert len(answer["references"]) == 1 and answer["totalReferences"] == 1


def test_hosted_embedder_is_used_for_documents(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text("def one(rows):\n    return rows\n")
    embedder = HostedEmbedder("voyage-2", "key", lambda texts, model, key: [[float(len(t)), 2.0] for t in texts])
    engine = Engine(spark, f"file://{tmp_path}/index", embedder=embedder)
    engine.index_project(rootPath=str(root))
    assert all(r.vector[1] == 2.0 for r in engine.store.read("chunks").select("vector").collect())
    assert HashingEmbedder().dimension() == 0


def test_configurations_from_answers():
    local, warnings = config.build()
    assert local["vectorStore"] == config.DEFAULTS["vectorStore"] and local["privacy"]["blockExternalCalls"] and warnings == []
    assert make_embedder(local) is not None
    cloud, warnings = config.build("cloud", "qdrant", "voyageai", address="a", token="t", api_key="k")
    assert cloud["vectorStore"]["config"] == {"address": "a", "token": "t"} and cloud["embedding"]["model"] == "voyage-2" and not cloud["privacy"]["blockExternalCalls"]
    assert warnings == [] and config.build("local", "milvus")[0]["vectorStore"]["config"] == {"address": config.LOCAL_ADDRESS, "standalone": True}
    assert len(config.build("local", "zilliz", "openai")[1]) == 3
    assert len(config.build("cloud")[1]) == 2
    for bad in ({"mode": "x"}, {"backend": "x"}, {"provider": "x"}, {"mode": "cloud", "provider": "openai"}):
        with pytest.raises(ConfigInvalid):
            config.build(**bad)
    assert "python" in nodes.available() and "markdown" not in nodes.available()
