"""Files that no parser was written for: an error row, in time that grows with their size."""

from __future__ import annotations

import random
import time

import pytest

from lodeseek.parse import lexing, nodes, symbols

DEEP = {"minus": "-" * 60_000 + "1", "parens": "(" * 100_000, "lists": "x = " + "[" * 5000 + "]" * 5000, "calls": "f(" * 50_000, "not": "not " * 100_000 + "x"}


@pytest.mark.parametrize("name", DEEP)
def test_deep_python_is_an_error_row(name):
    found, failed = symbols.extract(DEEP[name], "python")
    assert failed and not found
    tree = nodes.tree_of(DEEP[name], "python")
    assert tree[0]["tree_error"] and tree[1]["type"] == nodes.ERROR


@pytest.mark.parametrize("language", ["typescript", "go"])
@pytest.mark.parametrize("text", ["function f(\n", "func f(\n", "class A {\n", "((((]]]]", "{", "(" * 40 + "\n"], ids=range(6))
def test_a_megabyte_takes_seconds(language, text):
    code = text * (1_000_000 // len(text))
    began = time.time()
    symbols.extract(code, language)
    assert time.time() - began < 5


def test_trees_of_unmatched_brackets_take_seconds():
    began = time.time()
    for code in ("(" * 60_000 + "]" * 60_000, "([" * 60_000, ")" * 100_000):
        assert nodes.tree_of(code, "c")[0]["tree_error"]
    assert time.time() - began < 15


def test_brackets_match_as_by_a_walk_from_each():
    def walk(code, at):
        depth = 0
        for i in range(at, len(code)):
            depth += (code[i] in "([{") - (code[i] in ")]}")
            if depth == 0:
                return i
        return len(code) - 1

    rng = random.Random(1)
    for _ in range(500):
        code = "".join(rng.choice("([{)]}ab\n") for _ in range(rng.randint(1, 40)))
        for at, ch in enumerate(code):
            assert lexing.line_of(code, at) == code.count("\n", 0, at) + 1
            if ch in "([{":
                assert lexing.matching(code, at) == walk(code, at)
