"""Snippets, symbols, links between documents and code, sources and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.operators import chunks, linking, snippets, symbols
from lodeseek.parse import nodes
from lodeseek.parse import tables as parsers
from lodeseek.plans import fixtures
from lodeseek.plans.registry import Registry
from lodeseek.session import spread, table
from lodeseek.sources import ignore, languages

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_LINES = "l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents)"
NAME = "one"


def values(rows, names: str) -> str:
    quote = lambda v: "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v))
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({names})"


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


@R.add(f"WITH {_LINES} SELECT id, sha256(array_to_string(ls[greatest(1, 3 - 3):least(len(ls), 4 + 3)], chr(10))) AS digest FROM l WHERE len(ls) >= 2")
def snippet_context(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.size(F.split("text", "\n")) >= 2)
    return d.select(F.col("doc_id").alias("id"), F.sha2(snippets.context(F.col("text"), F.lit(3), F.lit(4)), 256).alias("digest"))


@R.add(f"WITH {_LINES} SELECT id, sha256(array_to_string(ls[1:20], chr(10))) AS digest FROM l")
def snippet_first20(spark, sf_dir):
    none = F.lit(None).cast("int")
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha2(snippets.snippet(F.col("text"), none, none), 256).alias("digest"))


@R.add(f"""WITH {_LINES}, r AS (SELECT id, unnest(ls) AS content, unnest(range(1, len(ls) + 1))::INT AS line FROM l)
SELECT id, line, md5(content) AS content, md5(concat_ws(chr(10), lag(content) OVER w, content, lead(content) OVER w)) AS context FROM r WINDOW w AS (PARTITION BY id ORDER BY line)""")
def context_lines_lag_lead(spark, sf_dir):
    rows = snippets.context_rows(snippets.lines(docs(spark, sf_dir)), 1)
    return rows.select("id", "line", F.md5("content").alias("content"), F.md5("context").alias("context"))


@R.add(f"""WITH {_LINES}, r AS (SELECT id, ls, unnest(range(1, len(ls) - 1))::INT AS s FROM l WHERE len(ls) >= 3)
SELECT id, s AS start_line, s + 2 AS end_line, md5(array_to_string(ls[s:s + 2], chr(10))) AS block FROM r""")
def sliding_line_windows(spark, sf_dir):
    rows = snippets.sliding_windows(snippets.lines(docs(spark, sf_dir)), 3)
    return rows.select("id", "start_line", "end_line", F.md5("block").alias("block"))


@R.add(f"""WITH {_LINES}, r AS (SELECT id, ls, unnest(ls) AS content, unnest(range(1, len(ls) + 1))::INT AS line FROM l),
o AS (SELECT id, ls, line, content, unnest(range(1, length(content) - {len(NAME)} + 2)) AS c FROM r WHERE length(content) >= {len(NAME)})
SELECT id, line, (c - 1)::INT AS "column", md5(array_to_string(ls[greatest(1, line - 1):least(len(ls), line + 1)], chr(10))) AS context
FROM o WHERE substring(content, c, {len(NAME)}) = '{NAME}'""")
def symbol_references(spark, sf_dir):
    found = symbols.references(docs(spark, sf_dir), NAME)
    return found.select("id", "line", "column", F.md5("context").alias("context"))


@R.add("SELECT doc_id, doc_id || ':' || (doc_id % 7 + 1) AS id, 'p' || (doc_id % 3) AS project_id, lang AS scope FROM documents WHERE source = 'src2' AND lang = 'en' AND doc_id % 3 = 1")
def symbol_definitions(spark, sf_dir):
    d = docs(spark, sf_dir)
    rows = d.select(
        "doc_id", chunks.chunk_id(F.col("doc_id").cast("string"), F.col("doc_id") % 7 + 1).alias("id"), F.col("source").alias("name"), F.lit("function").alias("type"),
        F.col("lang").alias("scope"), F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("project_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file_path"),
        F.lit(1).alias("line_start"), F.lit(2).alias("line_end"),
    )
    return symbols.definitions(rows, "src2", "function", "p1", "en").select("doc_id", "id", "project_id", "scope")


@R.add("SELECT DISTINCT source AS file_path FROM documents WHERE source IS NOT NULL")
def distinct_files(spark, sf_dir):
    return symbols.distinct_files(docs(spark, sf_dir).withColumnRenamed("source", "file_path"))


@R.add("""WITH c AS (SELECT event_id AS comment_id, user_id % 50 AS path, (event_id % 997)::INT AS end_line FROM events WHERE event_type = 'view'),
s AS (SELECT user_id % 50 AS path, (event_id % 997)::INT AS line, event_id AS ordinal, 's' || event_id AS name FROM events WHERE event_type = 'error')
SELECT c.path, c.comment_id, arg_min(s.name, s.ordinal) AS symbol FROM c LEFT JOIN s ON c.path = s.path AND s.line > c.end_line AND s.line <= c.end_line + 3 GROUP BY ALL""")
def comment_symbol_range_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("path", F.col("user_id") % 50).withColumn("at", (F.col("event_id") % 997).cast("int"))
    comments = e.where("event_type = 'view'").select("path", F.col("event_id").alias("comment_id"), F.col("at").alias("end_line"))
    syms = e.where("event_type = 'error'").select("path", F.col("at").alias("line"), F.col("event_id").alias("ordinal"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("name"))
    return symbols.comment_symbols(comments, syms).select("path", "comment_id", "symbol")


@R.add("SELECT page_id, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') OR starts_with(url, '//') THEN 'external' ELSE 'internal' END AS link_type FROM pages")
def link_types(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.link_type(F.col("url")).alias("link_type"))


@R.add("""SELECT page_id, p AS file_path FROM (SELECT page_id, regexp_replace(regexp_extract(url, '://[^?#]*'), '^://', '') AS p FROM pages)
WHERE regexp_matches(p, '^(?:\\.{0,2}/)?(?:[A-Za-z0-9_-]+/)*[A-Za-z0-9_-]+\\.[A-Za-z0-9_]+$')
UNION ALL SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) FROM pages WHERE regexp_matches(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '^(?:\\.{0,2}/)?(?:[A-Za-z0-9_-]+/)*[A-Za-z0-9_-]+\\.[A-Za-z0-9_]+$')""")
def file_path_refs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    whole = p.select("page_id", T.file_path_in(F.regexp_replace(F.regexp_extract("url", "://[^?#]*", 0), "^://", "")).alias("file_path"))
    below = p.select("page_id", T.file_path_in(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1)).alias("file_path"))
    return whole.unionByName(below).where("file_path IS NOT NULL")


@R.add("""WITH f AS (SELECT DISTINCT '/w/' || source || '/' || lang || '.py' AS file_path FROM documents),
r AS (SELECT DISTINCT '/d/' || lang AS doc_path, lang || '.py' AS ref, '/w/' || source || '/en.py' AS resolved FROM documents)
SELECT DISTINCT doc_path, ref, file_path FROM r, f WHERE ends_with(file_path, ref) OR file_path = resolved""")
def path_suffix_join(spark, sf_dir):
    d = docs(spark, sf_dir)
    files = d.select(F.concat(F.lit("/w/"), "source", F.lit("/"), "lang", F.lit(".py")).alias("file_path")).distinct()
    refs = d.select(
        F.concat(F.lit("/d/"), "lang").alias("doc_path"), F.concat("lang", F.lit(".py")).alias("ref"), F.concat(F.lit("/w/"), "source", F.lit("/en.py")).alias("resolved")
    )
    return linking.path_links(refs.distinct(), files)


#: Distances count code points, but DuckDB's count bytes: its twins first put a control character in place of each other character.
_CONTROLS = " || ".join(f"chr({i})" for i in range(1, 32) if i not in (9, 10, 13))
_CHARS = """chars AS (SELECT coalesce(string_agg(DISTINCT c, '' ORDER BY c), '') AS cs FROM (
  SELECT unnest(string_split(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '')) AS c FROM {}) WHERE c <> '')"""
_PLAIN = f"translate({{}}, cs, left({_CONTROLS}, length(cs)))"


@R.add(f"""WITH {_CHARS.format('benchmark')}, b AS (SELECT item_id, {_PLAIN.format('text')} AS t FROM benchmark, chars)
SELECT x.item_id AS a, y.item_id AS b, round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)), 6) AS similarity FROM b x JOIN b y ON x.item_id % 50 = 0 AND x.item_id <> y.item_id""")
def levenshtein_similarity(spark, sf_dir):
    """The items whose id is divisible by 50 against all items, in blocks."""
    blocks = 16
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    asked = b.where("item_id % 50 = 0").select(F.col("item_id").alias("a"), F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    items = b.select(F.col("item_id").alias("b"), F.col("text").alias("tb"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"))
    return asked.join(items, "block").where("a <> b").select("a", "b", F.round(T.edit_similarity(F.col("ta"), F.col("tb")), 6).alias("similarity"))


_NORM = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '' AND NOT starts_with(s, '//') AND NOT starts_with(s, '#')), chr(10))"


@R.add(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def normalize_code(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_code(F.col("text"))).alias("digest"))


@R.add(f"""WITH {_CHARS.format('documents')}, c AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, start_line, ls[start_line] || chr(10) || ls[start_line + 1] AS code FROM (SELECT doc_id, ls, unnest(range(1, len(ls)))::INT AS start_line FROM c WHERE len(ls) > 1)),
n AS (SELECT doc_id, start_line, {_PLAIN.format(_NORM.format('code'))} AS code FROM w, chars),
b AS (SELECT doc_id AS block_id, code FROM n WHERE start_line = 1 AND doc_id % 50 = 0),
p AS (SELECT block_id, doc_id, start_line, b.code AS l, n.code AS r, greatest(length(b.code), length(n.code)) AS longest FROM b JOIN n ON abs(length(b.code) - length(n.code)) <= 0.5 * greatest(length(b.code), length(n.code)))
SELECT block_id, doc_id::VARCHAR AS file_path, start_line, round(similarity, 6) AS similarity FROM (
  SELECT *, CASE WHEN longest = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein(l, r) / longest END AS similarity FROM p) WHERE similarity >= 0.5""")
def similar_code_windows(spark, sf_dir):
    """The opening two lines of the documents whose id is divisible by 50 as blocks, against every two lines of all documents."""
    lines = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("ls"))
    starts = lines.where(F.size("ls") >= 2).select("id", "ls", F.explode(F.sequence(F.lit(1), F.size("ls") - 1)).alias("start_line"))
    code = F.concat_ws("\n", F.element_at("ls", F.col("start_line")), F.element_at("ls", F.col("start_line") + 1))
    windows = starts.select(F.col("id").cast("string").alias("file_path"), "start_line", (F.col("start_line") + 1).alias("end_line"), F.lit(2).alias("n_lines"), code.alias("code"))
    blocks = lines.where((F.size("ls") >= 2) & (F.col("id") % 50 == 0)).select(F.col("id").alias("block_id"), F.lit(2).alias("n_lines"), F.concat_ws("\n", F.slice("ls", 1, 2)).alias("code"))
    return linking.similar_code(blocks, windows).select("block_id", "file_path", "start_line", F.round("similarity", 6).alias("similarity"))


# --- the fixture project: documents and code that refer to each other


def _evidence(spark):
    files = fixtures.files(spark)
    md = files.where("language = 'markdown'")
    code = files.where("language <> 'markdown' AND language <> 'unknown'").select(F.col("path").alias("file_path"), "language", "content")
    elements = parsers.markdown(md)
    refs = elements.where("kind = 'path'").select(
        F.col("path").alias("doc_path"), F.col("target").alias("ref"), linking.resolve(F.col("target"), F.col("path"), F.lit("/work")).alias("resolved")
    )
    by_path = linking.path_links(refs, code.select("file_path"))
    found = parsers.symbols(code.withColumnRenamed("file_path", "path")).select(F.col("path").alias("file_path"), "name", F.col("line_start").alias("line"))
    by_symbol = linking.symbol_links(md.select(F.col("path").alias("doc_path"), "content"), found)
    blocks = elements.where("kind = 'code'").select(F.concat_ws("#", "path", F.col("line").cast("string")).alias("block_id"), F.size(F.split("text", "\n")).alias("n_lines"), F.col("text").alias("code"))
    rows = snippets.lines(code, "file_path", "content")
    windows = snippets.sliding_windows(rows, 2).select(F.col("id").alias("file_path"), "start_line", "end_line", F.lit(2).alias("n_lines"), F.col("block").alias("code"))
    by_code = linking.similar_code(blocks, windows).withColumn("doc_path", F.element_at(F.split("block_id", "#"), 1))
    return by_path, by_symbol, by_code


PATH_LINKS = (
    ("/work/README.md", "src/shapes.ts", "/work/src/shapes.ts"), ("/work/README.md", "./cmd/main.go", "/work/cmd/main.go"), ("/work/docs/guide.md", "stats.py", "/work/src/stats.py"),
)
SYMBOL_LINKS = (
    ("/work/README.md", "Square", "/work/src/shapes.ts", 4), ("/work/docs/guide.md", "Table", "/work/src/stats.py", 14), ("/work/docs/guide.md", "Point", "/work/cmd/main.go", 4),
)


@R.add("SELECT * FROM " + values(PATH_LINKS, "doc_path, ref, file_path"))
def doc_path_links(spark, sf_dir):
    return _evidence(spark)[0]


@R.add("SELECT doc_path, name, file_path, line::INT AS line FROM " + values(SYMBOL_LINKS, "doc_path, name, file_path, line"))
def doc_symbol_links(spark, sf_dir):
    return _evidence(spark)[1].drop("mention")


_NORM_CODE = _NORM.format("code")
_EVIDENCE_SQL = f"""WITH files AS (SELECT * FROM {values(fixtures.FILES, "path, language, content")}),
p AS (SELECT * FROM {values(PATH_LINKS, "doc_path, ref, file_path")}),
s AS (SELECT * FROM {values(SYMBOL_LINKS, "doc_path, name, file_path, line")}),
b AS (SELECT path AS doc_path, unnest(regexp_extract_all(content, '```[a-z]+\\n([^`]*)\\n```', 1)) AS code FROM files WHERE language = 'markdown'),
w0 AS (SELECT path AS file_path, string_split(content, chr(10)) AS ls FROM files WHERE language NOT IN ('markdown', 'unknown')),
w AS (SELECT file_path, i AS start_line, ls[i] || chr(10) || ls[i + 1] AS code FROM (SELECT file_path, ls, unnest(range(1, len(ls))) AS i FROM w0)),
nb AS (SELECT doc_path, {_NORM_CODE} AS l FROM b), nw AS (SELECT file_path, start_line, {_NORM_CODE} AS r FROM w),
c AS (SELECT doc_path, file_path, start_line, similarity FROM (
  SELECT doc_path, file_path, start_line, CASE WHEN greatest(length(l), length(r)) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein(l, r) / greatest(length(l), length(r)) END AS similarity
  FROM nb, nw) WHERE similarity >= 0.5),
e AS (SELECT doc_path, file_path, 1.0::DOUBLE AS w, 'path' AS reason FROM p UNION ALL SELECT doc_path, file_path, 0.7::DOUBLE, 'symbol' FROM s
  UNION ALL SELECT doc_path, file_path, 0.8 * similarity, 'code' FROM c),
scores AS (SELECT doc_path, file_path, sum(w) AS score, list(DISTINCT reason ORDER BY reason) AS reasons FROM e GROUP BY ALL)
"""


@R.add(_EVIDENCE_SQL + "SELECT doc_path, file_path, round(score, 6) AS score, reasons FROM scores")
def related_score(spark, sf_dir):
    return linking.related_scores(*_evidence(spark)).withColumn("score", F.round("score", 6))


@R.add(_EVIDENCE_SQL + "SELECT doc_path, round(least(1.0::DOUBLE, sum(score) / 4), 6) AS relevance FROM scores GROUP BY doc_path ORDER BY relevance DESC, doc_path LIMIT 5")
def related_docs_topk(spark, sf_dir):
    scores = linking.related_scores(*_evidence(spark))
    return linking.related_documents(scores, 4).withColumn("relevance", F.round("relevance", 6))


@R.add(_EVIDENCE_SQL + """SELECT doc_path, 'path' AS kind, ref AS reference, 1.0::DOUBLE AS score FROM p UNION ALL SELECT doc_path, 'symbol', name, 0.7::DOUBLE FROM s
UNION ALL SELECT doc_path, 'code', file_path, round(similarity, 6) FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_path ORDER BY similarity DESC, file_path, start_line) AS n FROM c) WHERE n <= 3""")
def matched_refs_top3(spark, sf_dir):
    return linking.matched_references(*_evidence(spark)).withColumn("score", F.round("score", 6))


@R.add("""WITH e AS (SELECT lang AS doc_path, source AS file_path, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.8 * ((doc_id % 10) / 10) END::DOUBLE AS w,
  CASE doc_id % 3 WHEN 0 THEN 'path' WHEN 1 THEN 'symbol' ELSE 'code' END AS reason FROM documents)
SELECT doc_path, file_path, round(sum(w), 6) AS score, list(DISTINCT reason ORDER BY reason) AS reasons FROM e GROUP BY ALL""")
def related_score_sums(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("lang").alias("doc_path"), F.col("source").alias("file_path"), "doc_id")
    code = d.where("doc_id % 3 = 2").withColumn("similarity", (F.col("doc_id") % 10) / 10)
    found = linking.related_scores(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 = 1"), code)
    return found.withColumn("score", F.round("score", 6))


# --- sources


@R.add("SELECT path FROM " + values([(p,) for p in fixtures.SCAN_PATHS], "path") + """
WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|py|go|rs|java|c|cpp|h|hpp|ino|md)$') OR regexp_matches(path, '(^|/)platformio\\.ini$')""")
def scan_extension_filter(spark, sf_dir):
    return fixtures.scan_paths(spark).where(languages.is_scanned(F.col("path")))


@R.add("SELECT * FROM " + values([(p,) for p in ("src/a.ts", "lib/x.py", "docs/read.md", "docs/keep.md", "a.txt", "platformio.ini", "gen/keep.go", "main.ino", "deep/node_modules/q/i.js")], "path"))
def ignore_rules(spark, sf_dir):
    return fixtures.scan_paths(spark).where(~ignore.excluded(F.col("path"), fixtures.IGNORE_LAYER))


@R.add("SELECT * FROM " + values([r[:4] for r in languages.LANGUAGES], "extension, language, display_name, is_code"))
def language_dimension(spark, sf_dir):
    return languages.dimension(spark).drop("scanned")


_EXTS = [r[0] for r in languages.LANGUAGES] + [".txt", ""]


@R.add(f"""SELECT doc_id, coalesce(d.language, 'unknown') AS language FROM documents
LEFT JOIN {values([(i, r[1]) for i, r in enumerate(languages.LANGUAGES)], "n, language").replace(" AS t(", " AS d(")} ON doc_id % {len(_EXTS)} = d.n""")
def language_of_paths(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS) + 1).cast("int"))
    path = F.concat(F.lit("/w/file"), F.col("doc_id").cast("string"), ext)
    return docs(spark, sf_dir).select("doc_id", languages.language_of(path).alias("language"))


# --- parsers over the fixture project


@R.add("SELECT path, line::INT AS line, level::INT AS level, text FROM " + values([
    ("/work/README.md", 1, 1, "Measuring"), ("/work/README.md", 7, 2, "Usage"), ("/work/docs/guide.md", 1, 1, "Guide")], "path, line, level, text"))
def md_headings(spark, sf_dir):
    return parsers.markdown(fixtures.files(spark).where("language = 'markdown'")).where("kind = 'heading'").select("path", "line", "level", "text")


@R.add("SELECT path, line::INT AS line, end_line::INT AS end_line, language FROM " + values([
    ("/work/README.md", 10, 11, "ts"), ("/work/docs/guide.md", 5, 6, "python")], "path, line, end_line, language"))
def md_code_blocks(spark, sf_dir):
    return parsers.markdown(fixtures.files(spark).where("language = 'markdown'")).where("kind = 'code'").select("path", "line", "end_line", "language")


@R.add("SELECT * FROM " + values([("/work/README.md", "the guide", "docs/guide.md", "internal"), ("/work/README.md", "home", "https://example.org", "external")], "path, text, target, language"))
def md_links(spark, sf_dir):
    return parsers.markdown(fixtures.files(spark).where("language = 'markdown'")).where("kind = 'link'").select("path", "text", "target", "language")


@R.add("SELECT * FROM " + values([("/work/README.md", "plan", "img/plan.png")], "path, text, target"))
def md_images(spark, sf_dir):
    return parsers.markdown(fixtures.files(spark).where("language = 'markdown'")).where("kind = 'image'").select("path", "text", "target")


def _symbols(language, spark):
    return parsers.symbols(fixtures.files(spark).where(F.col("language") == language)).select("name", "type", "line_start", "line_end", "exported", F.size("members").alias("members"))


def _symbol_values(rows) -> str:
    return "SELECT name, type, a::INT AS line_start, b::INT AS line_end, e AS exported, m::INT AS members FROM " + values(rows, "name, type, a, b, e, m").replace("True", "true").replace("False", "false")


@R.add(_symbol_values([("Square", "class", 4, 8, True, 3), ("double", "constant", 10, 10, True, 0), ("double", "function", 10, 10, True, 0), ("LIMIT", "constant", 11, 11, False, 0)]))
def symbols_ts(spark, sf_dir):
    return _symbols("typescript", spark)


@R.add(_symbol_values([("RATE", "constant", 2, 2, True, 0), ("mean", "function", 5, 11, True, 0), ("Table", "class", 14, 15, True, 1), ("add", "function", 15, 15, True, 0)]))
def symbols_py(spark, sf_dir):
    return _symbols("python", spark)


@R.add(_symbol_values([("Point", "class", 4, 6, True, 0), ("Move", "method", 8, 10, True, 0), ("Unit", "constant", 12, 12, True, 0), ("main", "function", 14, 14, False, 0)]))
def symbols_go(spark, sf_dir):
    return _symbols("go", spark)


@R.add(_symbol_values([("LED", "constant", 2, 2, False, 0), ("Lamp", "class", 3, 7, False, 2), ("setup", "function", 8, 8, True, 0), ("loop", "function", 9, 9, True, 0)]))
def symbols_cpp(spark, sf_dir):
    return _symbols("cpp", spark)


@R.add("SELECT path, type, line::INT AS line, end_line::INT AS end_line, marker FROM " + values([
    ("/work/board/blink.ino", None, None, None, None)], "path, type, line, end_line, marker") + " WHERE type IS NOT NULL UNION ALL SELECT path, type, line::INT, end_line::INT, marker FROM " + values([
    ("/work/cmd/main.go", "line", 3, 3, None), ("/work/src/shapes.ts", "doc", 1, 3, None), ("/work/src/shapes.ts", "line", 9, 9, "TODO"),
    ("/work/src/stats.py", "doc", 1, 1, None), ("/work/src/stats.py", "doc", 6, 10, None), ("/work/src/stats.py", "line", 11, 11, "FIXME")], "path, type, line, end_line, marker"))
def comments(spark, sf_dir):
    return parsers.comments(fixtures.files(spark)).select("path", "type", "line", "end_line", "marker")


@R.add("SELECT * FROM " + values([("/work/src/shapes.ts", "param", "side", "the length of a side"), ("/work/src/stats.py", "args", "", None)], "path, name, value, description"))
def comment_tags(spark, sf_dir):
    return parsers.comments(fixtures.files(spark)).select("path", F.explode("tags").alias("t")).select("path", "t.name", "t.value", "t.description")


@R.add("""SELECT event_id, nullif(regexp_extract(t, '(TODO|FIXME|NOTE|HACK|XXX|BUG):', 1), '') AS marker FROM (
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'see TODO: x' WHEN 1 THEN 'BUG: a FIXME: b' WHEN 2 THEN 'todo: no' WHEN 3 THEN props ELSE 'HACK without' END AS t FROM events)""")
def markers(spark, sf_dir):
    case = F.expr("CASE event_id % 5 WHEN 0 THEN 'see TODO: x' WHEN 1 THEN 'BUG: a FIXME: b' WHEN 2 THEN 'todo: no' WHEN 3 THEN props ELSE 'HACK without' END")
    return table(spark, sf_dir, "events").select("event_id", T.marker_of(case).alias("marker"))


@R.add("SELECT section, key, string_split(v, '|') AS values, line::INT AS line FROM " + values([
    ("env:uno", "platform", "atmelavr", None), ("env:uno", "build_flags", "-D|FAST|-O2", None), ("env:uno", "lib_deps", "Servo|Wire", None), ("env:nano", "board", "nano", None),
    ("common", "framework", "arduino", None), (None, "error", "Unexpected line in section [env:uno]: stray", 11)], "section, key, v, line"))
def platformio(spark, sf_dir):
    return parsers.ini_options(fixtures.files(spark).where("path LIKE '%platformio.ini'")).select("section", "key", "values", "line")


# --- chunks


@R.add("""WITH l AS (SELECT doc_id, lang, text, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id || '.py:2' AS id, md5('sym' || doc_id || chr(10) || lang || chr(10) || left(coalesce(array_to_string(ls[2:3], chr(10)), ''), 500)) AS digest, 'py' AS file_type FROM l""")
def chunk_build(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit(".py")))
    syms = d.select(
        "path", F.lit(0).alias("ordinal"), F.concat(F.lit("sym"), F.col("doc_id").cast("string")).alias("name"), F.lit("function").alias("type"), F.lit("global").alias("scope"),
        F.col("lang").alias("docstring"), F.lit(2).alias("line_start"), F.lit(3).alias("line_end"),
    )
    built = chunks.build(syms, d.select("path", F.lit("python").alias("language"), F.col("text").alias("content")))
    return built.select("id", F.md5("text").alias("digest"), "file_type")


@R.add("SELECT source || ':' || (doc_id % 10) AS id, max(doc_id) AS ordinal FROM documents GROUP BY 1")
def chunk_dedup_keep_last(spark, sf_dir):
    rows = docs(spark, sf_dir).select(chunks.chunk_id(F.col("source"), F.col("doc_id") % 10).alias("id"), F.col("doc_id").alias("ordinal"))
    return chunks.keep_last(rows)


CHUNKS = (
    ("/work/README.md", "Measuring", "heading", "markdown", 1, 1), ("/work/README.md", "Usage", "heading", "markdown", 7, 7), ("/work/README.md", "ts", "code", "markdown", 10, 11),
    ("/work/docs/guide.md", "Guide", "heading", "markdown", 1, 1), ("/work/docs/guide.md", "python", "code", "markdown", 5, 6),
    ("/work/board/blink.ino", "LED", "constant", "cpp", 2, 2), ("/work/board/blink.ino", "Lamp", "class", "cpp", 3, 7), ("/work/board/blink.ino", "setup", "function", "cpp", 8, 8),
    ("/work/board/blink.ino", "loop", "function", "cpp", 9, 9), ("/work/cmd/main.go", "Point", "class", "go", 4, 6), ("/work/cmd/main.go", "Move", "method", "go", 8, 10),
    ("/work/cmd/main.go", "Unit", "constant", "go", 12, 12), ("/work/cmd/main.go", "main", "function", "go", 14, 14), ("/work/src/shapes.ts", "Square", "class", "typescript", 4, 8),
    ("/work/src/shapes.ts", "double", "function", "typescript", 10, 10), ("/work/src/shapes.ts", "LIMIT", "constant", "typescript", 11, 11),
    ("/work/src/stats.py", "RATE", "constant", "python", 2, 2), ("/work/src/stats.py", "mean", "function", "python", 5, 11), ("/work/src/stats.py", "Table", "class", "python", 14, 15),
    ("/work/src/stats.py", "add", "function", "python", 15, 15),
)


@R.add("SELECT path || ':' || a AS id, name, type, language, a::INT AS line_start, b::INT AS line_end FROM " + values(CHUNKS, "path, name, type, language, a, b"))
def project_chunks(spark, sf_dir):
    """Symbols and Markdown units of the fixture project as chunks, of each id the last."""
    files = fixtures.files(spark)
    found = parsers.symbols(files).select("path", "ordinal", "name", "type", "scope", "docstring", "line_start", "line_end")
    units = found.unionByName(parsers.markdown_units(parsers.markdown(files.where("language = 'markdown'"))))
    return chunks.keep_last(chunks.build(units, files)).select("id", "name", "type", "language", "line_start", "line_end")


@R.add("""WITH f AS (SELECT path, string_split(content, chr(10)) AS ls FROM """ + values(fixtures.FILES, "path, language, content") + """ WHERE language = 'markdown'),
r AS (SELECT path, list_filter(ls, lambda x: starts_with(trim(x), '#'))[1] AS head,
  trim(array_to_string(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')), ' ')) AS rest FROM f)
SELECT path, trim(ltrim(trim(head), '#')) AS title, CASE WHEN length(rest) > 100 THEN left(rest, 100) || '...' ELSE rest END AS snippet FROM r""")
def title_and_snippet(spark, sf_dir):
    return snippets.title_and_snippet(fixtures.files(spark).where("language = 'markdown'"))


# --- parsers over a generated corpus: a file for each document


@R.add(f"""WITH {fixtures.CORPUS_SQL}, m AS (SELECT *, unnest(range(0, k))::INT AS j FROM c WHERE kind = 1)
SELECT path, 'C' || i AS name, 'class' AS type, 1 AS line_start, k + 2 AS line_end, true AS exported, k AS members FROM c WHERE kind = 0
UNION ALL SELECT path, 'f' || i, 'function', k + 3, k + 3, true, 0 FROM c WHERE kind = 0
UNION ALL SELECT path, 'LIMIT' || i, 'constant', k + 4, k + 4, false, 0 FROM c WHERE kind = 0
UNION ALL SELECT path, 'LIMIT_' || i, 'constant', 1, 1, true, 0 FROM c WHERE kind = 1
UNION ALL SELECT path, 'C' || i, 'class', 4, 4 + greatest(1, 2 * k), true, k FROM c WHERE kind = 1
UNION ALL SELECT path, 'm' || j, 'function', 5 + 2 * j, 6 + 2 * j, true, 0 FROM m
UNION ALL SELECT path, 'f' || i, 'function', 7 + greatest(1, 2 * k), 8 + greatest(1, 2 * k), true, 0 FROM c WHERE kind = 1
UNION ALL SELECT path, 'S' || i, 'class', 3, 4 + k, true, 0 FROM c WHERE kind = 2
UNION ALL SELECT path, 'M', 'method', 6 + k, 6 + k, true, 0 FROM c WHERE kind = 2
UNION ALL SELECT path, 'f' || i, 'function', 8 + k, 8 + k, false, 0 FROM c WHERE kind = 2""")
def corpus_symbols(spark, sf_dir):
    found = parsers.symbols(fixtures.corpus(spark, sf_dir))
    return found.select("path", "name", "type", "line_start", "line_end", "exported", F.size("members").alias("members"))


@R.add(f"WITH {fixtures.CORPUS_SQL} SELECT path, 'line' AS type, k + 5 AS line, 'TODO' AS marker, 'TODO: t' || i AS content FROM c WHERE kind = 0")
def corpus_comments(spark, sf_dir):
    return parsers.comments(fixtures.corpus(spark, sf_dir)).select("path", "type", "line", "marker", F.trim("content").alias("content"))


@R.add(f"""WITH {fixtures.CORPUS_SQL}, n AS (
SELECT path, 'program' AS type, 1 AS n FROM c WHERE kind <> 1 UNION ALL SELECT path, 'block', CASE kind WHEN 0 THEN k + 2 ELSE 3 END FROM c WHERE kind <> 1
UNION ALL SELECT path, 'group', CASE kind WHEN 0 THEN k + 1 ELSE 3 END FROM c WHERE kind <> 1 UNION ALL SELECT path, 'comment', 1 FROM c WHERE kind = 0
UNION ALL SELECT path, 'class_def', 1 FROM c WHERE kind = 1 UNION ALL SELECT path, 'function_def', k + 1 FROM c WHERE kind = 1)
SELECT path, type, n::BIGINT AS n FROM n""")
def ast_node_types(spark, sf_dir):
    tree = nodes.nodes(fixtures.corpus(spark, sf_dir))
    return nodes.of_types(tree, ["program", "block", "group", "comment", "class_def", "function_def"]).groupBy("path", "type").agg(F.count("*").alias("n"))


@R.add(f"""WITH {fixtures.CORPUS_SQL} SELECT path, 'block' AS type, '{{ return x; }}' AS text FROM c WHERE kind = 0
UNION ALL SELECT path, 'block', '{{}}' FROM c WHERE kind = 2 UNION ALL SELECT path, 'name', 'x' FROM c WHERE kind = 1""")
def ast_node_at_position(spark, sf_dir):
    files = fixtures.corpus(spark, sf_dir)
    lines = F.split("content", "\n")
    back = F.when(F.col("language") == "typescript", 3).when(F.col("language") == "python", 1).otherwise(1)  # how far from the line's end
    row = F.size(lines) - F.when(F.col("language") == "typescript", 4).otherwise(2)
    places = files.select("path", row.alias("row"), (F.char_length(F.element_at(lines, row + 1)) - back).alias("col"))
    tree = nodes.nodes(files)
    found = nodes.at_positions(tree, places).join(tree, ["path", "node_id", "type"]).join(files.select("path", "content"), "path")
    return found.select("path", "type", nodes.text(F.col("content")).alias("text"))


@R.add(f"""WITH {fixtures.CORPUS_SQL} SELECT path, 0::BIGINT AS errors, CASE kind WHEN 0 THEN CASE WHEN k > 0 THEN 2 ELSE 1 END ELSE 1 END AS depth FROM c WHERE kind <> 1""")
def ast_depths(spark, sf_dir):
    """How deep brackets nest, and that nothing is in error."""
    tree = nodes.traverse(nodes.nodes(fixtures.corpus(spark, sf_dir)).where("path NOT LIKE '%.py'"), max_depth=5)
    return tree.groupBy("path").agg(F.count_if(F.col("type") == nodes.ERROR).alias("errors"), F.max("depth").alias("depth"))


@R.add(f"""WITH {fixtures.CORPUS_SQL}, e AS (SELECT path, CASE WHEN i % 2 = 0 THEN 'tail' END AS cut FROM c WHERE kind <> 1)
SELECT path, (cut IS NOT NULL) AS tree_error, CASE WHEN cut IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS errors FROM e""")
def ast_error_nodes(spark, sf_dir):
    """Every other file gets a bracket that is never closed."""
    files = fixtures.corpus(spark, sf_dir).where("language <> 'python'")
    even = F.regexp_extract("path", "([0-9]+)", 1).cast("long") % 2 == 0
    tree = nodes.nodes(files.withColumn("content", F.when(even, F.concat("content", F.lit("func broken( {\n}"))).otherwise(F.col("content"))))
    return tree.groupBy("path").agg(F.max("tree_error").alias("tree_error"), F.count_if(F.col("type") == nodes.ERROR).alias("errors"))


@R.add("""WITH c AS (SELECT doc_id AS i, (doc_id % 5)::INT AS k, '/w/' || doc_id || '.md' AS path FROM documents), m AS (SELECT *, unnest(range(0, k))::INT AS j FROM c)
SELECT path, 'heading' AS kind, 1 AS line, 'Title ' || i AS text, NULL AS target FROM c UNION ALL SELECT path, 'heading', 3 + 4 * j, 'Part ' || j, NULL FROM m
UNION ALL SELECT path, 'link', 5 + 4 * j, 'part ' || j, 'docs/p' || j || '.md' FROM m UNION ALL SELECT path, 'link', 5 + 4 * j, 'home', 'https://example.org/' || j FROM m
UNION ALL SELECT path, 'code', 3 + 4 * k, 'x = ' || i, NULL FROM c UNION ALL SELECT path, 'image', 7 + 4 * k, 'plan', 'img/' || i || '.png' FROM c
UNION ALL SELECT path, 'path', 7 + 4 * k, NULL, 'src/a' || i || '.py' FROM c""")
def corpus_markdown(spark, sf_dir):
    found = parsers.markdown(fixtures.markdown_corpus(spark, sf_dir))
    return found.select("path", "kind", "line", F.when(F.col("kind") != "path", F.col("text")).alias("text"), F.when(F.col("kind") != "heading", F.col("target")).alias("target"))
