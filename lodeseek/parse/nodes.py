"""Syntax trees as a table of nodes, numbered before their children, with positions from 0 in code points.

Python is read by its own parser; a node's type is the parser's name for it in lower case (``function_def``). TypeScript,
JavaScript, Go, Java, Rust and C-like languages give what nests for certain: literals, comments and bracketed groups. A file that
cannot be read, or a bracket without its partner, has a node of type ERROR, and has_error holds for all nodes around one."""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.parse.lexing import C_TOKENS, CLOSE, OPEN
from lodeseek.parse.tables import _table

NODES = "path string, node_id int, parent_id int, depth int, type string, start_row int, start_col int, end_row int, end_col int, has_error boolean, tree_error boolean"
BRACKETED = ("typescript", "javascript", "go", "java", "rust", "c", "cpp")
GROUPS = {"(": "group", "[": "list", "{": "block"}
ERROR = "ERROR"


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


class _Tree:
    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, parent: int | None, kind: str, start: tuple[int, int], end: tuple[int, int]) -> int:
        depth = 0 if parent is None else self.rows[parent]["depth"] + 1
        row = {"node_id": len(self.rows), "parent_id": parent, "depth": depth, "type": kind, "has_error": kind == ERROR}
        self.rows.append(row | {"start_row": start[0], "start_col": start[1], "end_row": end[0], "end_col": end[1]})
        return len(self.rows) - 1

    def done(self) -> list[dict]:
        for row in reversed(self.rows):  # children come after their parents
            if row["has_error"] and row["parent_id"] is not None:
                self.rows[row["parent_id"]]["has_error"] = True
        return [r | {"tree_error": self.rows[0]["has_error"]} for r in self.rows]


def _end(code: str) -> tuple[int, int]:
    return code.count("\n"), len(code) - code.rfind("\n") - 1


def python_tree(code: str) -> list[dict]:
    tree = _Tree()
    root = tree.add(None, "module", (0, 0), _end(code))
    lines = code.split("\n")

    def column(line: int, offset: int) -> int:
        return len(lines[line - 1].encode()[:offset].decode("utf-8", "ignore"))

    try:
        parsed = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        row = max(0, min((getattr(error, "lineno", None) or 1) - 1, len(lines) - 1))
        tree.add(root, ERROR, (row, 0), (row, len(lines[row])))
        return tree.done()
    waiting: list[tuple[ast.AST, int]] = [(c, root) for c in reversed(list(ast.iter_child_nodes(parsed)))]
    while waiting:
        node, parent = waiting.pop()
        if getattr(node, "lineno", None) is not None:
            start = (node.lineno - 1, column(node.lineno, node.col_offset))
            parent = tree.add(parent, snake(type(node).__name__), start, (node.end_lineno - 1, column(node.end_lineno, node.end_col_offset)))
        waiting += [(c, parent) for c in reversed(list(ast.iter_child_nodes(node)))]
    return tree.done()


def bracket_tree(code: str) -> list[dict]:
    starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def at(place: int) -> tuple[int, int]:
        import bisect

        row = bisect.bisect_right(starts, place) - 1
        return row, place - starts[row]

    tree = _Tree()
    tree.add(None, "program", (0, 0), at(len(code)))
    open_ones = [0]
    waiting = Counter()  # open groups by kind
    for m in re.finditer(C_TOKENS.pattern + r"|[()\[\]{}]", code, re.DOTALL):
        text = m[0]
        if text in OPEN:
            waiting[GROUPS[text]] += 1
            open_ones.append(tree.add(open_ones[-1], GROUPS[text], at(m.start()), at(m.end())))
        elif text in CLOSE:
            kind = GROUPS[OPEN[CLOSE.index(text)]]
            if not waiting[kind]:
                tree.add(open_ones[-1], ERROR, at(m.start()), at(m.end()))
                continue
            while True:  # groups inside that were never closed are errors up to here
                n = open_ones.pop()
                waiting[tree.rows[n]["type"]] -= 1
                tree.rows[n]["end_row"], tree.rows[n]["end_col"] = at(m.end())
                if tree.rows[n]["type"] == kind:
                    break
                tree.rows[n]["type"], tree.rows[n]["has_error"] = ERROR, True
        else:
            tree.add(open_ones[-1], "comment" if text.startswith(("//", "/*")) else "string", at(m.start()), at(m.end()))
    for n in open_ones[1:]:
        tree.rows[n]["type"], tree.rows[n]["has_error"] = ERROR, True
        tree.rows[n]["end_row"], tree.rows[n]["end_col"] = at(len(code))
    return tree.done()


def tree_of(code: str | None, language: str) -> list[dict]:
    """Nodes before their children. Unknown languages and missing code have none."""
    if code is None or (language != "python" and language not in BRACKETED):
        return []
    return python_tree(code) if language == "python" else bracket_tree(code)


def available() -> tuple[str, ...]:
    """The languages that have syntax trees."""
    return ("python", *BRACKETED)


def nodes(files: DataFrame) -> DataFrame:
    """files (path, language, content) -> NODES, in Arrow batches next to the scan."""
    return _table(files, ["path", "language", "content"], lambda p, lang, c: [{"path": p} | n for n in tree_of(c, lang)], NODES)


def traverse(tree: DataFrame, max_depth: int | None = None, skip_errors: bool = False) -> DataFrame:
    """The nodes that a walk from the root meets; node_id is its order. With skip_errors a node with an error hides what is below
    it, so a tree with any error is not entered at all."""
    if max_depth is not None:
        tree = tree.where(F.col("depth") <= max_depth)
    return tree.where(~F.col("tree_error")) if skip_errors else tree


def of_types(tree: DataFrame, types: Sequence[str]) -> DataFrame:
    return tree.where(F.col("type").isin(*types))


def errors(tree: DataFrame) -> DataFrame:
    return tree.where((F.col("type") == ERROR) | F.col("has_error"))


def position() -> Column:
    """A node's place as one struct."""
    return F.struct(*(F.col(c).alias(c) for c in ("start_row", "start_col", "end_row", "end_col")))


def contains(row: Column, col: Column) -> Column:
    """Whether a node holds a position: its end is outside."""
    return ~(
        (row < F.col("start_row")) | (row > F.col("end_row")) | ((row == F.col("start_row")) & (col < F.col("start_col")))
        | ((row == F.col("end_row")) & (col >= F.col("end_col")))
    )


def at_positions(tree: DataFrame, places: DataFrame) -> DataFrame:
    """places (path, row, col, ...) with the smallest node there (node_id, type; null where no node is): size is a thousand a row and one
    a column, and of equal ones the first in order counts. An equi-join on the path."""
    size = (F.col("end_row") - F.col("start_row")) * 1000 + F.col("end_col") - F.col("start_col")
    keys = [c for c in places.columns]
    found = places.join(tree, "path").where(contains(F.col("row"), F.col("col")))
    best = found.groupBy(*keys).agg(F.min_by(F.struct("node_id", "type"), F.struct(size, F.col("node_id"))).alias("_n"))
    return places.join(best, keys, "left").select(*keys, "_n.node_id", "_n.type")


def text(content: Column) -> Column:
    """The source between a node's ends; lines between the first and the last that are empty are left out, as is an empty first or last one."""
    lines = F.split(content, "\n")
    line = lambda row: F.coalesce(F.try_element_at(lines, row + 1), F.lit(""))
    first, last = line(F.col("start_row")), line(F.col("end_row"))
    one = F.substring(first, F.col("start_col") + 1, F.greatest(F.lit(0), F.col("end_col") - F.col("start_col")))
    head = F.when(first != "", F.array(F.substring(first, F.col("start_col") + 1, F.char_length(first)))).otherwise(F.array().cast("array<string>"))
    inner = F.filter(F.slice(lines, F.col("start_row") + 2, F.greatest(F.lit(0), F.col("end_row") - F.col("start_row") - 1)), lambda x: x != "")
    tail = F.when(last != "", F.array(F.substring(last, F.lit(1), F.col("end_col")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("start_row") == F.col("end_row"), one).otherwise(F.array_join(F.concat(head, inner, tail), "\n"))


def child_counts(tree: DataFrame) -> DataFrame:
    """(path, node_id, children, ordinal among its siblings)."""
    sibling = Window.partitionBy("path", "parent_id").orderBy("node_id")
    counts = tree.where("parent_id IS NOT NULL").groupBy("path", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    placed = tree.select("path", "node_id", (F.row_number().over(sibling) - 1).alias("ordinal"))
    return placed.join(counts, ["path", "node_id"], "left").select("path", "node_id", F.coalesce("children", F.lit(0)).alias("children"), "ordinal")
