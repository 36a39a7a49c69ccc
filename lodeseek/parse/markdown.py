"""Markdown structure: headings, fenced code, links, images and file paths in code spans, as rows."""

from __future__ import annotations

import re

from lodeseek.functions.text import FILE_PATH

HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`\s]*)")
INLINE = re.compile(
    r"(?P<code>(?<!`)(?P<ticks>`+)(?!`)(?P<span>.*?[^`])(?P=ticks)(?!`))"
    r"|(?P<image>!\[(?P<alt>[^\]]*)\]\(\s*(?P<src><[^>]*>|[^\s)]*)(?:\s+[\"'(][^)]*)?\))"
    r"|(?P<link>\[(?P<text>(?:\[[^\]]*\]|[^\[\]])*)\]\(\s*(?P<url><[^>]*>|[^\s)]*)(?:\s+[\"'(][^)]*)?\))"
)
PATH = re.compile(FILE_PATH)


def is_external(url: str) -> bool:
    return url.startswith(("http://", "https://", "//"))


def parse(content: str | None) -> list[dict]:
    """Elements in order: {"kind", "line" (from 1), "end_line", "level", "text", "target", "language"}.

    kind is heading, code, link, image or path. A fenced block ends on its start line plus its code's lines less one. A
    link's text is internal or external in "language"; a path's is absolute or relative there."""
    out: list[dict] = []
    lines = (content or "").split("\n")
    i, paragraph = 0, None
    while i < len(lines):
        line = lines[i]
        if fence := FENCE.match(line):
            start, body = i, []
            i += 1
            while i < len(lines) and not re.match(r"^ {0,3}" + re.escape(fence[1][0]) + "{" + str(len(fence[1])) + r",}[ \t]*$", lines[i]):
                body.append(lines[i])
                i += 1
            out.append(_row("code", start + 1, text="\n".join(body), language=fence[2] or None, end_line=start + max(1, len(body))))
            paragraph = None
        elif heading := HEADING.match(line):
            out.append(_row("heading", i + 1, level=len(heading[1]), text=(heading[2] or "").strip()))
            out += _inline(heading[2] or "", i + 1)
            paragraph = None
        elif paragraph is not None and (under := UNDERLINE.match(line)):
            out.append(_row("heading", i, level=1 if under[1][0] == "=" else 2, text=paragraph))
            paragraph = None
        else:
            out += _inline(line, i + 1)
            paragraph = line.strip() or None
        i += 1
    return out


def _row(kind: str, line: int, **more) -> dict:
    return {"kind": kind, "line": line, "end_line": line, "level": None, "text": None, "target": None, "language": None} | more


def _inline(text: str, line: int) -> list[dict]:
    out = []
    for m in INLINE.finditer(text):
        if m["code"] is not None:
            span = m["span"].strip()
            if PATH.match(span):
                out.append(_row("path", line, text=span, target=span, language="absolute" if span.startswith("/") else "relative"))
        elif m["image"] is not None:
            out.append(_row("image", line, text=m["alt"], target=m["src"].strip("<>")))
        else:
            url = m["url"].strip("<>")
            out.append(_row("link", line, text=m["text"], target=url, language="external" if is_external(url) else "internal"))
            out += [x for x in _inline(m["text"], line) if x["kind"] in ("image", "path")]
    return out
