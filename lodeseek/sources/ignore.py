"""gitignore-style patterns as expressions: each layer's last matching pattern decides, any layer that excludes excludes."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is never indexed.
DEFAULT_EXCLUSIONS = (
    "node_modules/**", ".git/**", "dist/**", "build/**", "coverage/**", ".next/**", ".nuxt/**", ".cache/**", "vendor/**", "__pycache__/**",
    "*.pyc", "target/**", "bin/**", "obj/**", "**/.env", "**/.env.*", "**/credentials.json", "**/secrets.json", "**/id_rsa", "**/id_rsa.pub",
    "**/id_ed25519", "**/id_ed25519.pub", "**/*.key", "**/*.pem", "**/*.p12",
)


def parse(text: str) -> list[str]:
    """The patterns of an ignore file: without comments, blank lines and unescaped trailing spaces."""
    rows = (re.sub(r"(?<!\\)\s+$", "", line) for line in text.splitlines())
    return [r for r in rows if r and not r.startswith("#")]


def to_regex(pattern: str) -> tuple[bool, str]:
    """(whether it re-includes, regex for a path relative to the root) of one pattern."""
    negated = pattern.startswith("!")
    body = pattern[1:] if negated else pattern
    body = body[1:] if body.startswith("\\") and body[1:2] in "#!" else body
    only_dirs = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + (2 if body.startswith("**", i) else 1)
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            group = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + group[1:] if group[0] in "!^" else group) + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    start = "^" if anchored else "^(?:.*/)?"
    return negated, start + out + ("/.*$" if only_dirs else "(?:/.*)?$")


def layer_excludes(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the last pattern of the layer that matches is not a negation."""
    verdict = F.lit(False)
    for pattern in patterns:
        negated, regex = to_regex(pattern)
        verdict = F.when(path.rlike(regex), F.lit(not negated)).otherwise(verdict)
    return verdict


def plain_excludes(path: Column, patterns: Sequence[str]) -> Column:
    """For a layer without negations: one alternation, one match per path."""
    return path.rlike("|".join(to_regex(p)[1] for p in patterns)) if patterns else F.lit(False)


def excluded(path: Column, *layers: Sequence[str], defaults: Sequence[str] = DEFAULT_EXCLUSIONS) -> Column:
    out = F.lit(False)
    for layer in (defaults, *layers):
        out = out | (layer_excludes(path, layer) if any(p.startswith("!") for p in layer) else plain_excludes(path, layer))
    return out


def matcher(*layers: Sequence[str], defaults: Sequence[str] = DEFAULT_EXCLUSIONS) -> Callable[[str], bool]:
    """excluded() as a function of one relative path, for listing a tree; a folder's path ends in a slash."""
    compiled = [[(negated, re.compile(regex)) for negated, regex in map(to_regex, layer)] for layer in (defaults, *layers)]

    def test(path: str) -> bool:
        return any(next((not negated for negated, regex in reversed(layer) if regex.search(path)), False) for layer in compiled)

    return test


def pruner(*layers: Sequence[str], defaults: Sequence[str] = DEFAULT_EXCLUSIONS) -> Callable[[str], bool]:
    """Whether nothing below a folder (a relative path without the slash) can be kept: a layer excludes the folder itself, or
    patterns that end in ``/*`` or ``/**`` exclude whatever it holds."""
    itself = matcher(*layers, defaults=defaults)
    whole = [[p for p in layer if re.fullmatch(r"[^\[?!]+/\*\*?", p)] for layer in (defaults, *layers) if not any(p.startswith("!") for p in layer)]
    holds = matcher(*whole, defaults=())
    return lambda folder: itself(folder + "/") or holds(folder + "/\0any\0")
