"""Build configuration in INI form: one row per environment."""

from __future__ import annotations

import re

COMMENT = (";", "#")
#: Fixed value: what a line that is no key and continues none is reported as.
UNEXPECTED = "Unexpected line in section [{}]: {}"
LIST_KEYS = {"build_flags": re.compile(r"\s+"), "lib_deps": None}


def parse(content: str | None) -> dict:
    """{"environments": [{"name", "options": {key: [values]}}], "common": {key: [values]}, "errors": [{"line", "message"}]}.

    A line with '=' starts a key even when indented; other indented lines continue the one before. build_flags are parted
    at spaces. Sections other than env:* and common are read over; what is neither is reported with its line (from 1)."""
    out: dict = {"environments": [], "common": {}, "errors": []}
    section = target = key = None
    for number, line in enumerate((content or "").split("\n"), 1):
        text = line.strip()
        if not text or text.startswith(COMMENT):
            continue
        if header := re.fullmatch(r"\[([^\]]+)\]", text):
            section, key, target = header[1], None, None
            if section.startswith("env:"):
                target = {}
                out["environments"].append({"name": section[4:], "options": target})
            elif section == "common":
                target = out["common"] = {}
        elif "=" in text and not text.startswith("="):
            key, _, value = (part.strip() for part in text.partition("="))
            if target is not None:
                target.pop(key, None)
                _add(target, key, value)
        elif key and line[0] in " \t":
            if target is not None:
                _add(target, key, text)
        elif section:
            out["errors"].append({"line": number, "message": UNEXPECTED.format(section, text)})
    return out


def _add(target: dict[str, list[str]], key: str, value: str) -> None:
    breaks = LIST_KEYS.get(key)
    values = [v for v in (breaks.split(value) if breaks else [value]) if v]
    if values:
        target.setdefault(key, []).extend(values)
