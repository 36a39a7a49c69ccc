"""Comments of source files: documentation, block and line comments, with markers and tags."""

from __future__ import annotations

import re

from lodeseek.functions.text import MARKERS

#: Fixed values per language: line comment signs, block comment (start, end) pairs, documentation starts.
C_LIKE = (("//",), (("/*", "*/"),))
SYNTAX: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...], tuple[str, ...]]] = {
    "typescript": (*C_LIKE, ("/**",)),
    "javascript": (*C_LIKE, ("/**",)),
    "python": (("#",), (('"""', '"""'), ("'''", "'''")), ('"""', "'''")),
    "go": (*C_LIKE, ()),
    "rust": (*C_LIKE, ("///", "//!")),
    "java": (*C_LIKE, ("/**",)),
    "c": (*C_LIKE, ("/**",)),
    "cpp": (*C_LIKE, ("/**", "///")),
}
MARKER = re.compile(f"({'|'.join(MARKERS)}):")
TAGS = (
    (re.compile(r"@(\w+)\s+(.+)"), True),
    (re.compile(r"#\s+(\w+)"), False),
    (re.compile(r"^(Args|Returns|Raises|Yields):"), False),
)


def tags_of(content: str) -> list[dict]:
    """{"name", "value", "description"} of each line's first fitting style: @name value - text, # Name, Name:."""
    out = []
    for line in content.split("\n"):
        for pattern, has_value in TAGS:
            if m := pattern.search(line):
                value, _, text = re.sub(r"\s+-\s+", "\0", m[2], count=1).partition("\0") if has_value else ("", "", "")
                name = m[1] if has_value else m[1].lower()
                out.append({"name": name, "value": value.strip(), "description": text.strip() or None})
                break
    return out


def extract(code: str | None, language: str) -> list[dict]:
    """Comments in order: {"type" (doc, block, line), "content", "line", "end_line" (from 1), "marker", "tags"}.

    A block comment starts at a line's beginning; a line comment at the first sign anywhere in a line, as in the
    original even inside a string. Consecutive documentation lines are one comment. Blank content is dropped for lines."""
    if not code or not code.strip() or language not in SYNTAX:
        return []
    signs, blocks, doc_starts = SYNTAX[language]
    lines = code.split("\n")
    out: list[dict] = []
    i = 0
    while i < len(lines):
        text = lines[i].strip()
        doc = next((d for d in doc_starts if text.startswith(d)), None)
        if doc is not None and doc.startswith("//"):
            last = i
            while last + 1 < len(lines) and lines[last + 1].strip().startswith(doc):
                last += 1
            out.append(_comment("doc", "\n".join(x.strip()[len(doc) :].strip() for x in lines[i : last + 1]), i, last))
            i = last + 1
            continue
        block = next(((a, b) for a, b in blocks if text.startswith(a)), None)
        if block is not None:
            opening = doc or block[0]
            body, last = _block(lines, i, opening, block[1])
            out.append(_comment("doc" if doc else "block", body, i, last))
            i = last + 1
            continue
        found = [p for p in (lines[i].find(s) for s in signs) if p >= 0]
        if found:
            sign = next(s for s in signs if lines[i].find(s) == min(found))
            body = lines[i][min(found) + len(sign) :].strip()
            if body:
                out.append(_comment("line", body, i, i))
        i += 1
    return out


def _block(lines: list[str], start: int, opening: str, closing: str) -> tuple[str, int]:
    first = lines[start].strip()[len(opening) :]
    if closing in first:
        return first.split(closing)[0].strip(), start
    body, last = [first], start
    for last in range(start + 1, len(lines)):
        head, end, _ = lines[last].partition(closing)
        body.append(head)
        if end:
            break
    else:
        last = len(lines) - 1
    clean = (re.sub(r"^\*+\s?", "", x.strip()) if closing == "*/" else x.strip() for x in body)
    return "\n".join(clean).strip(), last


def _comment(kind: str, content: str, start: int, end: int) -> dict:
    marker = MARKER.search(content)
    return {
        "type": kind, "content": content, "line": start + 1, "end_line": end + 1, "marker": marker[1] if marker else None,
        "tags": tags_of(content) if kind == "doc" else [],
    }
