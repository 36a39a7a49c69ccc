"""What the hand-written symbol readers share: blanking literals and comments, brackets, and splitting parameters."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

C_TOKENS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
OPEN, CLOSE = "([{", ")]}"
BRACKETS = re.compile(r"[()\[\]{}]")


def blank_literals(code: str) -> str:
    """The code with comments and the insides of strings as spaces; lines and columns stay."""

    def blank(m: re.Match) -> str:
        text = m[0]
        if text[0] in "\"'`":
            return text[0] + re.sub(r"[^\n]", " ", text[1:-1]) + text[-1:]
        return re.sub(r"[^\n]", " ", text)

    return C_TOKENS.sub(blank, code)


@lru_cache(maxsize=4)
def _pairs(code: str) -> dict[int, int]:
    """Of each bracket that is closed the place of the one that closes it, whatever their kinds; found in one walk."""
    open_ones: list[int] = []
    out: dict[int, int] = {}
    for m in BRACKETS.finditer(code):
        if m[0] in OPEN:
            open_ones.append(m.start())
        elif open_ones:
            out[open_ones.pop()] = m.start()
    return out


def matching(code: str, at: int) -> int:
    """Place of the bracket that closes the one at a place; the last place if none does."""
    return _pairs(code).get(at, len(code) - 1)


def depths(code: str) -> list[int]:
    """Depth of braces at each place."""
    out, depth = [], 0
    for ch in code:
        if ch == "}":
            depth -= 1
        out.append(depth)
        if ch == "{":
            depth += 1
    return out


def split_top(text: str, sep: str = ",") -> list[str]:
    """Pieces between separators that no bracket (angle ones included) encloses."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch in "([{<":
            depth += 1
        elif ch in ")]}" or (ch == ">" and text[i - 1 : i] != "="):
            depth = max(0, depth - 1)
        elif ch == sep and depth == 0:
            out.append(text[start:i])
            start = i + 1
    out.append(text[start:])
    return [x.strip() for x in out if x.strip()]


@lru_cache(maxsize=4)
def _line_starts(code: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", code))]


def line_of(code: str, at: int) -> int:
    """Line of a place, from 1."""
    return bisect_right(_line_starts(code), at)


def symbol(name: str, kind: str, scope: str, line: int, end_line: int, **more) -> dict:
    return {
        "name": name, "type": kind, "scope": scope, "line_start": line, "line_end": end_line, "parameters": [], "return_type": None, "extends": [],
        "implements": [], "members": [], "value_type": None, "docstring": None, "exported": False, "is_async": False,
    } | more


def param(name: str, kind: str | None = None, default: str | None = None, optional: bool = False) -> dict:
    return {"name": name, "type": kind, "default": default, "optional": optional}
