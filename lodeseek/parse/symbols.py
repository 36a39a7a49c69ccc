"""Symbols of source files. Python is read with its own parser; TypeScript, JavaScript, Go and C-like languages with small
readers over code whose comments and strings were blanked: they know declarations, not whole grammars."""

from __future__ import annotations

import ast
import re

from lodeseek.parse.lexing import blank_literals, depths, line_of, matching, param, split_top, symbol

KEYWORDS = {"if", "for", "while", "switch", "return", "else", "do", "catch", "sizeof", "new", "delete", "throw", "case", "defined", "function"}


def extract(code: str | None, language: str) -> tuple[list[dict], bool]:
    """(symbols in order, whether the code could not be read). Rust and Java have none, as have blank code and unknown languages."""
    readers = {"python": python, "typescript": typescript, "javascript": typescript, "go": go, "c": cpp, "cpp": cpp}
    if not code or not code.strip() or language not in readers:
        return [], False
    try:
        return readers[language](code), False
    except (SyntaxError, ValueError, RecursionError, IndexError, MemoryError):
        return [], True


# --- Python


def python(code: str) -> list[dict]:
    """Functions (methods too, besides being members), classes and module-level assignments; all-capital names are constants."""
    out: list[dict] = []

    def visit(node: ast.AST, top: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(_py_function(child))
                visit(child, False)
            elif isinstance(child, ast.ClassDef):
                members = [_py_function(m, "method") for m in child.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
                out.append(
                    symbol(child.name, "class", "global", child.lineno, child.end_lineno, extends=[ast.unparse(b) for b in child.bases], members=members,
                           docstring=ast.get_docstring(child), exported=not child.name.startswith("_"))
                )
                visit(child, False)
            elif top and isinstance(child, (ast.Assign, ast.AnnAssign)):
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                for t in (t for t in targets if isinstance(t, ast.Name)):
                    kind = "constant" if t.id == t.id.upper() and any(c.isalpha() for c in t.id) else "variable"
                    value_type = ast.unparse(child.annotation) if isinstance(child, ast.AnnAssign) else None
                    out.append(symbol(t.id, kind, "global", child.lineno, child.end_lineno, value_type=value_type, exported=not t.id.startswith("_")))
            elif top:
                visit(child, isinstance(child, (ast.If, ast.Try, ast.With)))

    visit(ast.parse(code), True)
    return out


def _py_function(node: ast.FunctionDef | ast.AsyncFunctionDef, kind: str = "function") -> dict:
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    pairs = [*zip(plain, defaults), *zip(a.kwonlyargs, a.kw_defaults)]
    params = [
        param(p.arg, ast.unparse(p.annotation) if p.annotation else None, ast.unparse(d) if d else None, d is not None) for p, d in pairs if p.arg not in ("self", "cls")
    ]
    for extra, mark in ((a.vararg, "*"), (a.kwarg, "**")):
        if extra:
            params.append(param(mark + extra.arg, ast.unparse(extra.annotation) if extra.annotation else None))
    return symbol(
        node.name, kind, "global" if kind == "function" else "class", node.lineno, node.end_lineno, parameters=params,
        return_type=ast.unparse(node.returns) if node.returns else None, docstring=ast.get_docstring(node), exported=not node.name.startswith("_"),
        is_async=isinstance(node, ast.AsyncFunctionDef),
    )


# --- TypeScript and JavaScript

TS_DECL = re.compile(
    r"(?P<export>\bexport\s+(?:default\s+)?)?(?:declare\s+)?(?:"
    r"(?P<async>async\s+)?function\s*\*?\s*(?P<function>[\w$]+)\s*(?:<[^(]*>)?\s*\("
    r"|(?:abstract\s+)?class\s+(?P<class>[\w$]+)"
    r"|interface\s+(?P<interface>[\w$]+)"
    r"|(?:const\s+)?enum\s+(?P<enum>[\w$]+)"
    r"|(?P<how>const|let|var)\s+(?P<var>[\w$]+)\s*(?::\s*(?P<vtype>[^=;\n]+?))?\s*(?==|;|\n|$)"
    r")"
)
TS_MEMBER = re.compile(
    r"(?P<mods>(?:\b(?:public|private|protected|static|readonly|async|abstract|override|get|set)\s+)*)(?P<name>[#\w$]+)\s*(?:<[^(]*>)?(?P<mark>[?!]?)\s*(?P<call>\()?"
)


def typescript(code: str) -> list[dict]:
    clean = blank_literals(code)
    depth = depths(clean)
    out: list[dict] = []
    for m in TS_DECL.finditer(clean):
        if m.start() and (clean[m.start() - 1].isalnum() or clean[m.start() - 1] in "._$"):
            continue
        exported, line = bool(m["export"]), line_of(clean, m.start())
        if m["function"]:
            open_at = m.end() - 1
            close = matching(clean, open_at)
            body, returns = _ts_after(clean, close + 1)
            out.append(symbol(m["function"], "function", "global", line, line_of(clean, body), parameters=_ts_params(code, clean, open_at, close), return_type=returns, exported=exported, is_async=bool(m["async"])))
        elif m["class"] or m["interface"]:
            brace = clean.find("{", m.end())
            if brace < 0:
                continue
            end = matching(clean, brace)
            head = code[m.end() : brace]
            extends = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|$)", head, re.DOTALL)
            implements = re.search(r"\bimplements\s+(.*)$", head, re.DOTALL)
            out.append(
                symbol(m["class"] or m["interface"], "class" if m["class"] else "interface", "global", line, line_of(clean, end),
                       extends=split_top(extends[1]) if extends else [], implements=split_top(implements[1]) if implements else [],
                       members=_ts_members(code, clean, depth, brace, end) if m["class"] and clean[end] == "}" else [], exported=exported)
            )
        elif m["enum"]:
            brace = clean.find("{", m.end())
            end = matching(clean, brace) if brace >= 0 else m.end()
            names = [re.match(r"[\w$]+", x) for x in split_top(clean[brace + 1 : end])] if brace >= 0 else []
            out.append(symbol(m["enum"], "enum", "global", line, line_of(clean, end), members=[symbol(x[0], "property", "class", line, line) for x in names if x], exported=exported))
        elif m["var"]:
            out += _ts_variable(code, clean, m, line, exported)
    return out


def _ts_variable(code: str, clean: str, m: re.Match, line: int, exported: bool) -> list[dict]:
    kind = "constant" if m["how"] == "const" else "variable"
    value_type = m["vtype"].strip() if m["vtype"] else None
    arrow = re.compile(r"\s*=\s*(?P<async>async\s+)?(?:(?P<open>\()|(?P<single>[\w$]+)\s*=>)").match(clean, m.end())
    end = m.end()
    found = []
    if arrow:
        open_at = arrow.end() - 1
        close = matching(clean, open_at) if arrow["open"] else arrow.end()
        tail = re.compile(r"\s*(?::\s*(?P<ret>[^=;{]+?))?\s*=>\s*").match(clean, close + 1) if arrow["open"] else None
        if tail or arrow["single"]:
            start = tail.end() if tail else arrow.end()
            start += len(clean[start:]) - len(clean[start:].lstrip())
            end = matching(clean, start) if clean[start : start + 1] == "{" else start
            params = _ts_params(code, clean, open_at, close) if arrow["open"] else [param(arrow["single"])]
            found.append(symbol(m["var"], "function", "global", line, line_of(clean, end), parameters=params, return_type=tail["ret"].strip() if tail and tail["ret"] else None, exported=exported, is_async=bool(arrow["async"])))
    return [symbol(m["var"], kind, "global", line, line_of(clean, end), value_type=value_type, exported=exported), *found]


def _ts_after(clean: str, at: int) -> tuple[int, str | None]:
    """(end of the body that follows a parameter list, return type)."""
    m = re.compile(r"\s*(?::\s*(?P<ret>[^{;]+?))?\s*(?P<body>\{|;|\n|$)").match(clean, at)
    if not m:
        return at, None
    end = matching(clean, m.end() - 1) if m["body"] == "{" else at
    return end, m["ret"].strip() if m["ret"] else None


def _ts_params(code: str, clean: str, open_at: int, close: int) -> list[dict]:
    out = []
    for text in split_top(code[open_at + 1 : close]) if clean[close : close + 1] == ")" else []:  # a list that is never closed has none
        m = re.match(r"(?:(?:public|private|protected|readonly)\s+)*(?P<name>\.{3}[\w$]+|[\w$]+|[\[{].*?[\]}])\s*(?P<opt>\?)?\s*(?::\s*(?P<type>.*?))?\s*(?:=(?!>)\s*(?P<default>.*))?$", text, re.DOTALL)
        if m:
            out.append(param(m["name"], m["type"] or None, m["default"], bool(m["opt"] or m["default"])))
    return out


def _ts_members(code: str, clean: str, depth: list[int], brace: int, end: int) -> list[dict]:
    """Methods and fields right inside the class's braces."""
    out, at = [], brace + 1
    while at < end:
        m = TS_MEMBER.search(clean, at, end)
        if not m:
            break
        line = line_of(clean, m.start())
        if m["call"]:
            close = matching(clean, m.end() - 1)
            stop, returns = _ts_after(clean, close + 1)
            if m["name"] not in KEYWORDS:
                kind = "constructor" if m["name"] == "constructor" else "method"
                out.append(symbol(m["name"], kind, "class", line, line_of(clean, max(stop, close)), parameters=_ts_params(code, clean, m.end() - 1, close), return_type=returns, is_async="async" in m["mods"]))
            at = max(stop, close) + 1
        else:
            stop = at = m.end()
            while stop < end and clean[stop] not in ";\n":
                stop = matching(clean, stop) + 1 if clean[stop] in "([{" else stop + 1
            kind = re.match(r"\s*:\s*([^=;\n]+)", clean[m.end() : stop])
            out.append(symbol(m["name"], "property", "class", line, line_of(clean, stop), value_type=kind[1].strip() if kind else None))
            at = stop + 1
    return out


# --- Go

GO_FUNC = re.compile(r"^func\s*(?:\((?P<receiver>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(", re.MULTILINE)
GO_TYPE = re.compile(r"^type\s+(?P<name>\w+)\s+(?P<what>struct|interface)\b", re.MULTILINE)
GO_VALUE = re.compile(r"^(?P<how>const|var)\s+(?:(?P<group>\()|(?P<name>\w+)\s*(?P<type>[^=\n]*))", re.MULTILINE)


def go(code: str) -> list[dict]:
    """Functions, methods, structs, interfaces, constants and variables; upper-case names are exported."""
    clean = blank_literals(code)
    found: list[tuple[int, dict]] = []
    for m in GO_FUNC.finditer(clean):
        close = matching(clean, m.end() - 1)
        brace = clean.find("{", close)
        end = matching(clean, brace) if brace >= 0 else close
        returns = clean[close + 1 : brace].strip() if brace >= 0 else None
        kind = "method" if m["receiver"] is not None else "function"
        found.append((m.start(), symbol(m["name"], kind, "class" if kind == "method" else "global", line_of(clean, m.start()), line_of(clean, end), parameters=_go_params(clean[m.end() : close] if clean[close : close + 1] == ")" else ""), return_type=returns or None, exported=m["name"][0].isupper())))
    for m in GO_TYPE.finditer(clean):
        brace = clean.find("{", m.end())
        end = matching(clean, brace) if brace >= 0 else m.end()
        found.append((m.start(), symbol(m["name"], "class" if m["what"] == "struct" else "interface", "global", line_of(clean, m.start()), line_of(clean, end), exported=m["name"][0].isupper())))
    for m in GO_VALUE.finditer(clean):
        kind = "constant" if m["how"] == "const" else "variable"
        rows = [(m.start(), m["name"], m["type"])]
        if m["group"]:
            close = matching(clean, m.end() - 1)
            rows = [(x.start(), x[1], x[2]) for x in re.compile(r"^\s*(\w+)[ \t]*([^=\n]*)", re.MULTILINE).finditer(clean, m.end(), close)]
        for at, name, value_type in rows:
            found.append((at, symbol(name, kind, "global", line_of(clean, at if not m["group"] else clean.index(name, at)), line_of(clean, clean.index(name, at)), value_type=value_type.strip() or None, exported=name[0].isupper())))
    return [s for _, s in sorted(found, key=lambda x: x[0])]


def _go_params(text: str) -> list[dict]:
    out, waiting = [], []
    for piece in split_top(text):
        name, _, kind = piece.partition(" ")
        waiting.append(name)
        if kind:
            out += [param(n, kind.strip()) for n in waiting]
            waiting = []
    return out + [param(n) for n in waiting]


# --- C, C++ and Arduino

CPP_FUNC = re.compile(r"(?P<ret>[A-Za-z_][\w:<>,*&\s]*?[\s*&])(?P<name>~?[A-Za-z_]\w*(?:::~?\w+)*)\s*\((?P<params>[^(){};]*)\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{")
CPP_CLASS = re.compile(r"\b(?:class|struct)\s+(?P<name>\w+)\s*(?:final\s*)?(?::\s*(?P<bases>[^{;]+))?\{")
CPP_VALUE = re.compile(r"^(?P<type>(?:(?:static|const|constexpr|volatile|extern|unsigned|signed)\s+)*[A-Za-z_][\w:<>]*(?:\s*[*&]+|\s))\s*(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*=[^=;][^;]*;", re.MULTILINE)
ENTRY_POINTS = ("setup", "loop")


def cpp(code: str) -> list[dict]:
    """Functions with a body, classes and structs with their members, and initialised variables at file level."""
    clean = re.sub(r"^[ \t]*#.*$", lambda m: " " * len(m[0]), blank_literals(code), flags=re.MULTILINE)
    depth = depths(clean)
    found: list[tuple[int, dict]] = []
    classes = []
    for m in CPP_CLASS.finditer(clean):
        end = matching(clean, m.end() - 1)
        classes.append((m.end(), end))
        bases = [re.sub(r"^(?:(?:public|private|protected|virtual)\s+)+", "", b) for b in split_top(m["bases"] or "")]
        found.append((m.start(), symbol(m["name"], "class", "global", line_of(clean, m.start()), line_of(clean, end), extends=bases, members=_cpp_members(clean[m.end() : end] if clean[end] == "}" else "", line_of(clean, m.end())))))
    for m in CPP_FUNC.finditer(clean):
        name = m["name"]
        if name in KEYWORDS or m["ret"].split()[-1:] in (["return"], ["else"], ["new"]) or any(a <= m.start("name") < b for a, b in classes):
            continue
        end = matching(clean, m.end() - 1)
        found.append((m.start("ret"), symbol(name, "function", "global", line_of(clean, m.start("name")), line_of(clean, end), parameters=_cpp_params(m["params"]), return_type=m["ret"].strip(), exported=name in ENTRY_POINTS)))
    for m in CPP_VALUE.finditer(clean):
        if depth[m.start()] == 0 and m["type"].strip() not in KEYWORDS:
            kind = "constant" if "const" in m["type"] else "variable"
            found.append((m.start(), symbol(m["name"], kind, "global", line_of(clean, m.start()), line_of(clean, m.end()), value_type=m["type"].strip())))
    return [s for _, s in sorted(found, key=lambda x: x[0])]


def _cpp_params(text: str) -> list[dict]:
    out = []
    for piece in split_top(text):
        left, _, default = piece.partition("=")
        m = re.match(r"(?P<type>.*?[\s*&])(?P<name>\w+)\s*(?:\[[^\]]*\])?$", left.strip(), re.DOTALL)
        if left.strip() != "void":
            out.append(param(m["name"] if m else left.strip(), m["type"].strip() if m else left.strip(), default.strip() or None, bool(default.strip())))
    return out


def _cpp_members(body: str, first_line: int) -> list[dict]:
    out, depth = [], depths(body)
    for m in re.finditer(r"(?P<type>[A-Za-z_~][\w:<>,*&\s]*?[\s*&])?(?P<name>~?\w+)\s*(?P<call>\((?P<params>[^()]*)\)[^;{]*[;{])?(?P<end>(?:=[^;]*)?;)?", body):
        if depth[m.start("name")] != 0 or not (m["call"] or (m["end"] and m["type"])) or m["name"] in KEYWORDS:
            continue
        line = first_line + body.count("\n", 0, m.start("name"))
        kind = re.sub(r"\b(?:public|private|protected)\s*:|\bvirtual\b|\bstatic\b", "", m["type"] or "").strip() or None
        if m["call"]:
            out.append(symbol(m["name"], "method", "class", line, line, parameters=_cpp_params(m["params"]), return_type=kind))
        else:
            out.append(symbol(m["name"], "property", "class", line, line, value_type=kind))
    return out
