"""The tools of the engine as one Python object: index, search, look up symbols, find related documents, status, clear, health.

Inputs are checked like the tools' own schemas; answers are plain dictionaries (to_json gives the text form).
Tables live in a snapshot store, a row of each keeps its project, so one store serves many projects."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek import __version__
from lodeseek.admin import status
from lodeseek.admin.embedding import CachedEmbedder, Embedder, HashingEmbedder, embed_documents
from lodeseek.admin.errors import InvalidParams, as_engine_error
from lodeseek.admin.telemetry import Metrics, metrics
from lodeseek.operators import bm25, chunks, hybrid, latent, linking, snippets, symbols, vector_index, vectors
from lodeseek.operators.keyword_index import KeywordIndex
from lodeseek.parse import tables as parsers
from lodeseek.sources import languages
from lodeseek.sources.scan import ScanOptions, list_one, read_files
from lodeseek.sources.store import Conflict, Store
from lodeseek.sources.tree import scan_tree
from lodeseek.streaming.queue import UpdateQueue
from lodeseek.streaming.watcher import Watcher, WatchOptions

#: Each tool's inputs: name, type, required, default.
TOOLS: dict[str, tuple[tuple[str, type, bool, object], ...]] = {
    "index_project": (("rootPath", str, True, None), ("languages", list, False, None), ("excludePatterns", list, False, None), ("includeDocuments", bool, False, True)),
    "search_code": (("query", str, True, None), ("projectId", str, False, None), ("fileTypes", list, False, None), ("languages", list, False, None), ("topK", int, False, 10)),
    "get_symbol": (("symbolName", str, True, None), ("symbolType", str, False, None), ("projectId", str, False, None), ("scope", str, False, None)),
    "find_related_docs": (("filePath", str, False, None), ("symbolName", str, False, None), ("projectId", str, False, None), ("topK", int, False, 5)),
    "get_index_status": (("projectId", str, False, None),),
    "clear_index": (("projectId", str, False, None), ("confirm", bool, False, False)),
    "health_check": (),
}
_KINDS = {str: "string", list: "array", bool: "boolean", int: "integer"}


def input_schema(tool: str) -> dict:
    rows = TOOLS[tool]
    return {
        "type": "object", "properties": {n: {"type": _KINDS[t]} | ({"default": d} if d is not None else {}) for n, t, _, d in rows},
        "required": [n for n, _, needed, _ in rows if needed],
    }


def checked(tool: str, given: dict) -> dict:
    """The tool's inputs with defaults; raises on missing, unknown or ill-typed ones."""
    rows = {n: (t, needed, d) for n, t, needed, d in TOOLS[tool]}
    if unknown := given.keys() - rows.keys():
        raise InvalidParams(f"unknown input {', '.join(sorted(unknown))}")
    out = {}
    for name, (kind, needed, default) in rows.items():
        value = given.get(name, default)
        if needed and (value is None or value == ""):
            raise InvalidParams(f"{name} is required")
        if value is not None and (not isinstance(value, kind) or (kind is int and isinstance(value, bool))):
            raise InvalidParams(f"{name} must be {_KINDS[kind]}")
        out[name] = value
    return out


def to_json(fn: Callable[[], dict]) -> tuple[str, bool]:
    """(text, whether it is an error)."""
    try:
        return json.dumps(fn(), indent=2, default=str), False
    except Exception as error:  # noqa: BLE001  the boundary of the tools
        return json.dumps(as_engine_error(error).to_dict(), indent=2, default=str), True


@dataclass
class Engine:
    """Documents and queries are embedded by the same embedder: the given one's kind is made anew in each task (its cache
    stays on the driver), so it and what it holds must be picklable."""

    spark: SparkSession
    root: str
    embedder: Embedder = field(default_factory=lambda: CachedEmbedder(HashingEmbedder()))
    progress: Callable[[str], None] = lambda step: None
    metrics: Metrics = field(default_factory=metrics)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root)
        self.keywords = KeywordIndex(self.store)
        self.embedder.initialize()
        self.health = status.HealthChecker(__version__, self._probe_store, lambda: self.embedder.embed("probe"))
        self._watchers: dict[str, tuple[Watcher, UpdateQueue]] = {}

    def _probe_store(self) -> None:
        if self.store.exists("chunks"):
            self.store.read("chunks").limit(1).count()

    # --- index

    def _parts(self, files: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
        """(files with their kind, chunks) of scanned files (path, language, kind, content)."""
        code = files.where("kind = 'code'")
        units = parsers.symbols(code).select("path", "ordinal", "name", "type", "scope", "docstring", "line_start", "line_end")
        units = units.unionByName(parsers.markdown_units(parsers.markdown(files.where("kind = 'markdown'"))))
        return files, chunks.keep_last(chunks.build(units, files, project)).drop("ordinal")

    def _put(self, name: str, rows: DataFrame | None, gone: DataFrame | None, key: list[str], sort_by: str | None = None) -> None:
        """rows in place of those whose key is gone; only what changes is written."""
        if self.metrics.on and rows is not None and name in ("files", "chunks"):  # written in one pass, without an order
            with self.metrics.measured(rows, f"lodeseek.index.{name}", rows=F.count(F.lit(1))) as counted:
                return self._put_rows(name, counted.df, gone, key, sort_by)
        self._put_rows(name, rows, gone, key, sort_by)

    def _put_rows(self, name: str, rows: DataFrame | None, gone: DataFrame | None, key: list[str], sort_by: str | None) -> None:
        if not self.store.exists(name):
            if rows is not None:
                self.store.write(name, rows, sort_by)
            return
        self.metrics.store_operation("delete" if rows is None else "upsert")
        self.store.change(name, rows, gone, key)

    def _write(self, files: DataFrame, units: DataFrame, project: str, gone: DataFrame) -> None:
        """gone (project_id[, file_path]): whose rows are replaced."""
        key = gone.columns
        self.progress("files")
        self._put("files", files.select(F.lit(project).alias("project_id"), F.col("path").alias("file_path"), "language", "kind", "content"), gone, key)
        self.progress("chunks")
        old = self.store.read("chunks").join(gone, key, "left_semi").select(F.col("id").alias("doc_id")) if self.store.exists("chunks") else None
        embedder = getattr(self.embedder, "inner", self.embedder)
        self._put("chunks", embed_documents(units, lambda: embedder), gone, key)
        self.progress("keyword index")
        now = self.store.read("chunks").join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi") if "file_path" in key else (
            self.store.read("chunks").where(F.col("project_id") == project)
        )
        now = now.where(F.col("project_id") == project)
        self._put("postings", bm25.postings(now, "id", "text", with_positions=True), old, ["doc_id"], "term")
        self._put("doc_stats", bm25.doc_stats(now, "id", "text"), old, ["doc_id"])
        if self.keywords.exists():
            self.keywords.replace(now, old, "id", "text")

        if self.store.exists("chunk_index"):
            index = vector_index.StoredVectorIndex(self.store, "chunk_index")
            coded = vector_index.encoded(now, index.coder(), "id", "vector")
            self._put("chunk_index", coded, None if old is None else old.select(F.col("doc_id").alias("id")), ["id"])

    def _atomically(self, change: Callable[[], None], attempts: int = 8) -> None:
        """All tables of a change are published at once; where another writer came first it is done again on what that one left."""
        for attempt in range(1, attempts + 1):
            try:
                with self.store.transaction():
                    return change()
            except Conflict:
                if attempt == attempts:
                    raise
                time.sleep(0.05 * attempt)

    def _project(self, project: str) -> DataFrame:
        return self.spark.createDataFrame([(project,)], "project_id string")

    def index_project(self, **given) -> dict:
        args = checked("index_project", given)
        root, project = args["rootPath"], args["rootPath"]
        began = time.time()
        files = scan_tree(self.spark, root, ScanOptions(exclude=args["excludePatterns"] or ()), project)
        self.progress("scanComplete")
        if args["languages"]:
            files = files.where(F.col("language").isin(*(x.lower() for x in args["languages"])) | (F.col("kind") == "markdown"))
        if not args["includeDocuments"]:
            files = files.where("kind <> 'markdown'")
        files, units = self._parts(files, project)
        answer: dict = {}

        def change() -> None:
            self._write(files, units, project, self._project(project))
            answer.update(self._summary(project, root, time.time() - began))

        self._atomically(change)
        return answer

    def _totals(self, project: str) -> None:
        """The project's row of index_metadata, counted anew after a change; a project that was never indexed has none."""
        if self.store.exists("index_metadata"):
            known = self.store.read("index_metadata").where(F.col("project_id") == project).select("root_path").first()
            if known is not None:
                self._summary(project, known.root_path, 0.0)

    def _summary(self, project: str, root: str, seconds: float) -> dict:
        kinds = {r.kind: r["count"] for r in self.store.read("files").where(F.col("project_id") == project).groupBy("kind").count().collect()}
        own = self.store.read("chunks").where(F.col("project_id") == project)
        counts = own.agg(F.count("*").alias("v"), F.count_if(~F.col("type").isin("heading", "code")).alias("s")).first()
        indexed, failed = kinds.get("code", 0) + kinds.get("markdown", 0) + kinds.get("ini", 0), kinds.get("unsupported", 0)
        row = self.spark.createDataFrame([(project, root, "indexed", indexed, counts.s, counts.v)], "project_id string, root_path string, status string, total_files long, total_symbols long, total_vectors long")
        row = row.withColumn("last_indexed", F.current_timestamp())
        row = row.select("project_id", "root_path", "status", "last_indexed", "total_files", "total_symbols", "total_vectors")
        self.store.write("index_metadata", status.upsert_metadata(self.store.read("index_metadata"), row) if self.store.exists("index_metadata") else row)
        self.metrics.index(indexed, counts.s)
        return {"success": True, "projectId": project, "stats": {"totalFiles": indexed + failed, "indexedFiles": indexed, "failedFiles": failed, "totalSymbols": counts.s, "totalVectors": counts.v, "processingTime": seconds}}

    def update_files(self, project: str, changed: DataFrame, deleted: DataFrame | None = None) -> None:
        """changed (path, language, kind, content) and deleted (path): every row of these files goes, then the new ones come.
        A handful of files: what is written is as large as they are."""
        gone = changed.select(F.col("path").alias("file_path"))
        if deleted is not None:
            gone = gone.union(deleted.select("path"))
        files, units = self._parts(changed, project)

        def change() -> None:
            self._write(files, units, project, gone.select(F.lit(project).alias("project_id"), "file_path"))
            self._totals(project)

        self._atomically(change)

    def update_file(self, path: str, project: str) -> None:
        """Reads one file of a project again; one that is not there any more, or is of no kind that is indexed, goes."""
        listed = list_one(self.spark, path)
        if listed is None or not languages.is_scanned_path(listed[1]):
            return self.remove_file(path, project)
        rel = F.lit(listed[1])
        content = F.make_valid_utf8(F.col("content").cast("string")).alias("content")
        self.update_files(project, read_files(self.spark, [listed]).select("path", languages.language_of(rel).alias("language"), languages.kind_of(rel).alias("kind"), content))

    index_file = update_file

    def remove_file(self, path: str, project: str) -> None:
        """Every row of the file goes; nothing happens if there is none."""
        self._atomically(lambda: self._remove(path, project))

    def _remove(self, path: str, project: str) -> None:
        if not self.store.exists("files"):
            return
        plain = path.split(":", 1)[-1].lstrip("/") if ":" in path else path.lstrip("/")
        known = self.store.read("files").where((F.col("project_id") == project) & F.regexp_replace("file_path", "^[a-z0-9+.-]+:/+", "/").eqNullSafe("/" + plain))
        gone = known.select("project_id", "file_path")
        if gone.isEmpty():
            return
        gone = self.spark.createDataFrame(gone.collect(), gone.schema)  # one file
        old = self.store.read("chunks").join(F.broadcast(gone), gone.columns, "left_semi").select(F.col("id").alias("doc_id"))
        for name in ("postings", "doc_stats"):
            self._put(name, None, old, ["doc_id"])
        if self.keywords.exists():
            self.keywords.delete(old)
        if self.store.exists("chunk_index"):
            self._put("chunk_index", None, old.select(F.col("doc_id").alias("id")), ["id"])
        for name in ("files", "chunks"):
            self._put(name, None, gone, gone.columns)
        self._totals(project)

    remove_from_index = remove_file

    # --- vectors

    def learn_embedder(self, settings: latent.Settings = latent.Settings()) -> latent.LatentModel:
        """Fits latent vectors on all chunks, stores them, embeds the chunks anew and answers queries with them from now on."""
        model = latent.fit(self.store.read("chunks"), settings, "id", "text")
        embedder = latent.LatentEmbedder(model)

        def change() -> None:
            self.store.write("latent_terms", model.table(self.spark))
            self.store.write("chunks", embed_documents(self.store.read("chunks").drop("vector"), lambda: embedder))
            if self.store.exists("chunk_index"):
                self.index_vectors()

        self._atomically(change)
        self.embedder = embedder
        return model

    def use_learned_embedder(self) -> None:
        """The stored model again, in another session."""
        self.embedder = latent.LatentEmbedder(latent.LatentModel.of_table(self.store.read("latent_terms")))

    def index_keywords(self) -> None:
        """Posting blocks of the chunks' texts; searches open the blocks that can hold a hit from now on, and changes keep them."""
        self._atomically(lambda: self.keywords.create(self.store.read("chunks"), "id", "text"))

    def index_vectors(self, **fitting) -> None:
        """Cells and codes of the chunks' vectors; searches read the cells near the query from now on, and changes keep them."""
        index = vector_index.StoredVectorIndex(self.store, "chunk_index")
        self._atomically(lambda: index.create(self.store.read("chunks"), "id", "vector", **fitting))

    def _nearest(self, vector: Sequence[float], k: int) -> DataFrame:
        if self.store.exists("chunk_index"):
            return vector_index.StoredVectorIndex(self.store, "chunk_index").search(vector, k, probes=16)
        return vectors.top_k(self.store.read("chunks"), vector, k, id_col="id", vector_col="vector")

    # --- watching

    def enable_watching(self, project: str, options: WatchOptions = WatchOptions()) -> Watcher:
        """Changes below the project's root are queued and indexed one at a time, until disable_watching()."""
        if project in self._watchers:
            return self._watchers[project][0]
        queue, watcher = UpdateQueue(self.update_file), Watcher(self.spark, project, options)
        base = project.rstrip("/")
        for event in options.events:
            watcher.on(event, lambda rel: queue.enqueue(f"{base}/{rel}", project))
        watcher.start()
        queue.start()
        self._watchers[project] = (watcher, queue)
        return watcher

    def disable_watching(self, project: str) -> None:
        if (pair := self._watchers.pop(project, None)) is not None:
            pair[0].stop()
            pair[1].stop()

    def watching(self) -> dict[str, dict]:
        """The queue's figures of each project that is watched."""
        return {project: queue.stats() for project, (_, queue) in self._watchers.items()}

    def shutdown(self) -> None:
        """Ends all watching and releases the embedder; may be called again."""
        for project in list(self._watchers):
            self.disable_watching(project)
        self.embedder.dispose()

    # --- search

    def search_code(self, **given) -> dict:
        args, began = checked("search_code", given), time.time()
        if not args["query"].strip() or not self.store.exists("chunks"):
            return {"results": [], "totalResults": 0, "searchTime": 0}
        k, units = args["topK"], self.store.read("chunks")
        if self.keywords.exists():
            keyword = self.keywords.search(args["query"], 2 * k)
        else:
            keyword = bm25.search(self.store.read("postings"), self.store.read("doc_stats"), args["query"], 2 * k)
        keyword = keyword.withColumnRenamed("doc_id", "id")
        vector = self._nearest(self.embedder.embed(args["query"]), 2 * k)
        meta = units.select("id", "language", "file_type", "project_id", "file_path", "name", "type", "line_start", "line_end")
        if args["projectId"]:
            meta = meta.where(F.col("project_id") == args["projectId"])
        where = hybrid.Filter(args["fileTypes"], args["languages"], ignore_case=True)
        hits = hybrid.search(keyword, vector, k, metadata=meta, where=where).where("file_path IS NOT NULL")
        files = self.store.read("files").select("file_path", "content")
        found = hits.join(files, "file_path", "left").select(
            "id", "score", "file_path", F.coalesce("language", F.lit("unknown")).alias("language"), "name", "type", "line_start", "line_end",
            snippets.snippet(F.col("content"), F.col("line_start"), F.col("line_end")).alias("snippet"),
        )
        rows = [r.asDict() for r in found.orderBy(F.desc("score"), "id").collect()]  # at most topK
        self.metrics.store_operation("search")
        self.metrics.results(len(rows))
        return {"results": rows, "totalResults": len(rows), "searchTime": time.time() - began}

    def get_symbol(self, max_definitions: int = 100, max_references: int = 1000, **given) -> dict:
        """The first definitions and references, with the number of all there are."""
        args = checked("get_symbol", given)
        if not self.store.exists("chunks"):
            return {"definitions": [], "references": [], "totalDefinitions": 0, "totalReferences": 0}
        units, files, name = self.store.read("chunks"), self.store.read("files"), args["symbolName"]
        found = symbols.definitions(units, name, args["symbolType"], args["projectId"], args["scope"]).join(files.select("file_path", "content"), "file_path", "left")
        shown = found.select("file_path", "name", "type", "scope", "language", "line_start", "line_end", snippets.context(F.col("content"), F.col("line_start"), F.col("line_end"), 0).alias("snippet"))
        if args["projectId"]:
            files = files.where(F.col("project_id") == args["projectId"])
        refs = symbols.references(files.where("kind = 'code'"), name, "file_path", "content")
        counts = {"totalDefinitions": shown.count(), "totalReferences": refs.count()}
        return {
            "definitions": [r.asDict() for r in shown.orderBy("file_path", "line_start").limit(max_definitions).collect()],
            "references": [{"file_path": r.id, "line": r.line, "column": r.column, "context": r.context} for r in refs.orderBy("id", "line", "column").limit(max_references).collect()],
        } | counts

    def find_related_docs(self, **given) -> dict:
        args = checked("find_related_docs", given)
        if not args["filePath"] and not args["symbolName"]:
            raise InvalidParams("filePath or symbolName is required")
        if not self.store.exists("files"):
            return {"documents": [], "totalResults": 0}
        files = self.store.read("files")
        if args["projectId"]:
            files = files.where(F.col("project_id") == args["projectId"])
        code = files.where("kind = 'code'")
        if args["filePath"]:
            code = code.where(F.col("file_path").endswith(args["filePath"]))
        else:
            code = code.join(symbols.definitions(self.store.read("chunks"), args["symbolName"]).select("file_path").distinct(), "file_path", "left_semi")
        docs = files.where("kind = 'markdown'")
        by_path, by_symbol, by_code = self._evidence(docs, code)
        n = code.count()
        best = linking.related_documents(linking.related_scores(by_path, by_symbol, by_code), max(1, n), args["topK"])
        # Only the few best documents' matches are gathered.
        matches = linking.matched_references(by_path, by_symbol, by_code).join(best.select("doc_path"), "doc_path", "left_semi")
        matched = matches.groupBy("doc_path").agg(F.array_sort(F.collect_list(F.struct("kind", "reference", "score"))).alias("matches"))
        about = snippets.title_and_snippet(docs.withColumnRenamed("file_path", "path"))
        rows = best.join(matched, "doc_path").join(about.withColumnRenamed("path", "doc_path"), "doc_path").orderBy(F.desc("relevance"), "doc_path").collect()
        return {"documents": [r.asDict(recursive=True) for r in rows], "totalResults": len(rows)}

    def _evidence(self, docs: DataFrame, code: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        elements = parsers.markdown(docs.select(F.col("file_path").alias("path"), "content"))
        roots = docs.select(F.col("file_path").alias("path"), F.col("project_id").alias("root"))
        refs = elements.where("kind = 'path'").join(roots, "path").select(
            F.col("path").alias("doc_path"), F.col("target").alias("ref"), linking.resolve(F.col("target"), F.col("path"), F.col("root")).alias("resolved")
        )
        by_path = linking.path_links(refs, code.select("file_path"))
        found = parsers.symbols(code.select(F.col("file_path").alias("path"), "language", "content")).select(F.col("path").alias("file_path"), "name", F.col("line_start").alias("line"))
        by_symbol = linking.symbol_links(docs.select(F.col("file_path").alias("doc_path"), "content"), found)
        blocks = elements.where("kind = 'code'").select(F.concat_ws("#", "path", F.col("line").cast("string")).alias("block_id"), F.size(F.split("text", "\n")).alias("n_lines"), F.col("text").alias("code"))
        sizes = blocks.select("n_lines").distinct()
        rows = code.select("file_path", F.split("content", "\n").alias("ls")).join(F.broadcast(sizes), F.size("ls") >= F.col("n_lines"))
        starts = rows.select("file_path", "ls", "n_lines", F.explode(F.sequence(F.lit(1), F.size("ls") - F.col("n_lines") + 1)).alias("start_line"))
        windows = starts.select("file_path", "start_line", (F.col("start_line") + F.col("n_lines") - 1).alias("end_line"), "n_lines", F.array_join(F.slice("ls", F.col("start_line"), F.col("n_lines")), "\n").alias("code"))
        by_code = linking.similar_code(blocks, windows).withColumn("doc_path", F.regexp_replace("block_id", "#[0-9]+$", ""))
        return by_path, by_symbol, by_code

    # --- administration

    def get_index_status(self, **given) -> dict:
        args = checked("get_index_status", given)
        if not self.store.exists("index_metadata"):
            return {"projects": []}
        meta = status.status_of(self.store.read("index_metadata"), args["projectId"])
        meta = meta.withColumn("index_size", status.index_size(F.col("total_vectors"), F.col("total_symbols"), self.embedder.dimension()))
        return {"projects": [r.asDict() for r in meta.orderBy("project_id").collect()]}

    def clear_index(self, **given) -> dict:
        args = checked("clear_index", given)
        if not args["confirm"]:
            raise InvalidParams("confirm must be true")
        if not self.store.exists("index_metadata"):
            return {"success": True, "clearedProjects": [], "message": "nothing is indexed"}
        answer: dict = {}
        self._atomically(lambda: answer.update(self._clear(args["projectId"])))
        return answer

    def _clear(self, project: str | None) -> dict:
        meta = self.store.read("index_metadata")
        names = [r.project_id for r in meta.select("project_id").collect() if project in (None, r.project_id)]
        if project is None:
            for table in ("index_metadata", "files", "chunks", "postings", "doc_stats", "chunk_index", "chunk_index_coder", *(f"{self.keywords.name}_{t}" for t in ("state", "docs", "terms", "blocks", "gone"))):
                self.store.drop(table)
        elif names:
            gone = self._project(project)
            if self.store.exists("chunks"):
                old = self.store.read("chunks").where(F.col("project_id") == project).select(F.col("id").alias("doc_id"))
                for table in ("postings", "doc_stats"):
                    self._put(table, None, old, ["doc_id"])
                if self.keywords.exists():
                    self.keywords.delete(old)
                if self.store.exists("chunk_index"):
                    self._put("chunk_index", None, old.select(F.col("doc_id").alias("id")), ["id"])
            for table in ("files", "chunks", "index_metadata"):
                self._put(table, None, gone, ["project_id"])
        return {"success": True, "clearedProjects": names, "message": f"cleared {len(names)}"}

    def health_check(self, **given) -> dict:
        checked("health_check", given)
        return self.health.check()

    def call(self, tool: str, args: dict | None = None) -> tuple[str, bool]:
        """A tool by its name, as text."""
        from lodeseek.admin.errors import MethodNotFound

        def run() -> dict:
            if tool not in TOOLS:
                raise MethodNotFound(tool)
            return getattr(self, tool)(**checked(tool, args or {}))

        self.metrics.request(tool)
        began = time.perf_counter()
        text, is_error = to_json(run)
        self.metrics.duration((time.perf_counter() - began) * 1000)
        self.metrics.memory_mb()
        if is_error:
            self.metrics.error(tool, str(json.loads(text).get("code")))
        return text, is_error


def tool_names() -> Sequence[str]:
    return list(TOOLS)
