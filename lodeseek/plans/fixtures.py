"""A small project of files, for the operators whose input no driver table has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = (
    ("/work/src/shapes.ts", "typescript", """/** Shapes that can be measured.
 * @param side - the length of a side
 */
export class Square extends Shape implements Sized {
  private side: number = 1;
  constructor(side: number) { this.side = side; }
  area(scale?: number): number { return this.side * this.side; }
}
// TODO: circles
export const double = (n: number) => n * 2;
const LIMIT: number = 10;
"""),
    ("/work/src/stats.py", "python", '''"""Sums over rows."""
RATE = 0.5


def mean(rows: list, skip=0) -> float:
    """Mean of rows.

    Args:
        rows
    """
    return sum(rows) / len(rows)  # FIXME: empty rows


class Table(Base):
    def add(self, row): pass
'''),
    ("/work/cmd/main.go", "go", """package main

// Point is a place.
type Point struct {
	X, Y int
}

func (p *Point) Move(dx, dy int) error {
	return nil
}

const Unit = 1

func main() { /* NOTE: entry */ }
"""),
    ("/work/board/blink.ino", "cpp", """#include <Arduino.h>
const int LED = 13;
class Lamp : public Part {
public:
  void on(int level) { write(level); }
  int pin;
};
void setup() { pinMode(LED, OUTPUT); }
void loop() { toggle(LED); }
"""),
    ("/work/README.md", "markdown", """# Measuring

See `src/shapes.ts`, `./cmd/main.go` and `Square`, then [the guide](docs/guide.md) or [home](https://example.org).

![plan](img/plan.png)

Usage
-----

```ts
export const double = (n: number) => n * 2;
const LIMIT: number = 10;
```
"""),
    ("/work/docs/guide.md", "markdown", """# Guide

`Table` and `Point` hold rows; `stats.py` sums them.

```python
def mean(rows: list, skip=0) -> float:
    return sum(rows) / len(rows)
```
"""),
    ("/work/platformio.ini", "unknown", """; boards
[common]
framework = arduino
[env:uno]
platform = atmelavr
build_flags = -D FAST
  -O2
lib_deps =
  Servo
  Wire
stray
[env:nano]
board = nano
"""),
)

SCAN_PATHS = (
    "src/a.ts", "src/b.test.tsx", "lib/x.py", "node_modules/p/i.js", "deep/node_modules/q/i.js", "dist/out.js", ".env", "conf/.env.local", "keys/site.pem",
    "docs/read.md", "docs/keep.md", "a.txt", "platformio.ini", "gen/auto.go", "gen/keep.go", "tmp/cache.c", "main.ino", "x/secrets.json", "mod.pyc", "build/m.rs",
)
IGNORE_LAYER = ("gen/*", "!gen/keep.go", "tmp/", "*.test.tsx")


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILES), "path string, language string, content string")


def scan_paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in SCAN_PATHS], "path string")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content): a source file for each document, whose symbols follow from its id (see CORPUS_SQL): a class
    with id % 5 members, functions, a constant and a comment, in TypeScript, Python or Go by id % 3."""
    from pyspark.sql import functions as F

    from lodeseek.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id").withColumn("k", (F.col("doc_id") % 5).cast("int"))
    i, parts = F.col("doc_id").cast("string"), F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))
    each = lambda form: F.array_join(F.transform(parts, lambda m: F.format_string(form, m)), "")
    ts = F.concat(
        F.lit("export class C"), i, F.lit(" extends B {\n"), each("  m%d(a: number): number { return a; }\n"), F.lit("}\nexport function f"), i,
        F.lit("(x: string, y?: number): string { return x; }\nconst LIMIT"), i, F.lit(" = 1;\n// TODO: t"), i, F.lit("\n"),
    )
    py = F.concat(
        F.lit("LIMIT_"), i, F.lit(" = 1\n\n\nclass C"), i, F.lit("(B):\n"), F.when(F.col("k") == 0, "    pass\n").otherwise(each("    def m%d(self, a: int) -> int:\n        return a\n")),
        F.lit("\n\ndef f"), i, F.lit("(x: str, y: int = 1) -> str:\n    return x\n"),
    )
    go = F.concat(
        F.lit("package p\n\ntype S"), i, F.lit(" struct {\n"), each("\tF%d int\n"), F.lit("}\n\nfunc (s S"), i, F.lit(") M(a int) int { return a }\n\nfunc f"), i, F.lit("() {}\n")
    )
    kind = F.col("doc_id") % 3
    return docs.select(
        F.concat(F.lit("/w/"), i, F.when(kind == 0, ".ts").when(kind == 1, ".py").otherwise(".go")).alias("path"),
        F.when(kind == 0, "typescript").when(kind == 1, "python").otherwise("go").alias("language"),
        F.when(kind == 0, ts).when(kind == 1, py).otherwise(go).alias("content"),
    )


CORPUS_SQL = """c AS (SELECT doc_id AS i, (doc_id % 5)::INT AS k, doc_id % 3 AS kind, '/w/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.go' END AS path FROM documents)"""


def markdown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a Markdown file for each document, with id % 5 sections, each with a link, and one code block."""
    from pyspark.sql import functions as F

    from lodeseek.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id").withColumn("k", (F.col("doc_id") % 5).cast("int"))
    i = F.col("doc_id").cast("string")
    parts = F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))
    sections = F.array_join(F.transform(parts, lambda m: F.format_string("## Part %d\n\nSee [part %d](docs/p%d.md), or [home](https://example.org/%d).\n\n", m, m, m, m)), "")
    content = F.concat(F.lit("# Title "), i, F.lit("\n\n"), sections, F.lit("```python\nx = "), i, F.lit("\n```\n\nRead `src/a"), i, F.lit(".py`, ![plan](img/"), i, F.lit(".png)\n"))
    return docs.select(F.concat(F.lit("/w/"), i, F.lit(".md")).alias("path"), content.alias("content"))
