"""Secret scanning with structural confirmation.

Base kinds are patterns: ``assign`` (a keyword, ``:`` or ``=``, a value of six characters or more),
``access`` (AKIA key ids) and ``hex`` (runs of 24 or more). The structural kinds report a base64 or hex
candidate only after it was decoded and parsed: ``pem`` (armoured blocks whose body is DER, an OpenSSH
key, or cipher blocks under headers that say so), ``jwt`` (three parts whose header is JSON with an ``alg``), ``ssh`` (OpenSSH private keys and wire
format public keys, every length field checked) and ``der`` (an ASN.1 sequence whose nested lengths fill
the bytes exactly, with integers, identifiers or key octets inside, as PKCS#1, PKCS#8, SEC1 and X.509 have).

Spans count code points, end exclusive; null texts count as empty. Each text is searched whole; a search
is skipped only where it cannot match (no keyword, or no unspaced stretch long enough).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.arrowtools import limit_batches, map_batches

#: In the order in which spans of one start are listed: the base kinds first.
KINDS = ("assign", "access", "hex", "pem", "jwt", "ssh", "der")
BASE_KINDS = KINDS[:3]
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----\s*+")
PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*+: [^\n]*+\n")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]*+")
ENCRYPTED = re.compile(r"Proc-Type: 4,ENCRYPTED\s+DEK-Info: ([A-Z0-9]+(?:-[A-Z0-9]+)*),[0-9A-Fa-f]{8,}\s")
TOKEN_PARTS = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{4,}+)\.[A-Za-z0-9_-]*+")
TOKEN_START = re.compile(r"\be[yw]")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_ANY = re.compile(r"[0-9A-Fa-f]{80,}")
MIN_ASSIGN, MIN_STRETCH = 6, 20


def unbase64(text: str) -> bytes | None:
    """Strict decoding of either alphabet, padding optional; None if it is not base64."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_node(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end of the content) of the element at a place; None where no well-formed one starts."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n]), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= len(data) else None


def der_tags(data: bytes, at: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the elements that fill data[at:end] exactly, with those nested in them; None if any length is off."""
    tags: list[int] = []
    while at < end:
        node = der_node(data, at)
        if node is None or node[2] > end or depth > 24:
            return None
        tag, start, at = node
        tags.append(tag)
        if tag & 0x20:
            inner = der_tags(data, start, at, depth + 1)
            if inner is None:
                return None
            tags += inner
    return tags


def is_der_key(data: bytes) -> bool:
    """An outer SEQUENCE that fills the data, holding at least three elements, among them numbers, identifiers or key bytes.
    Signed public structures (certificates, requests, revocation lists: two sequences and a bit string) are no secrets."""
    node = der_node(data, 0)
    if node is None or node[0] != 0x30 or node[2] != len(data):
        return False
    tags = der_tags(data, node[1], node[2])
    if tags is None or len(tags) < 3 or not any(t in (0x02, 0x03, 0x04, 0x06) for t in tags):
        return False
    outer, at = [], node[1]
    while at < node[2]:
        tag, _, at = der_node(data, at)
        outer.append(tag)
    return outer != [0x30, 0x30, 0x03]


def is_pem_secret(headers: str, body: str) -> bool:
    """The armoured body is a key in DER or OpenSSH's format, or its headers say how it is encrypted and it is whole cipher blocks."""
    data = unbase64(re.sub(r"\s", "", body))
    if not data:
        return False
    if ENCRYPTED.search(headers + "\n"):
        return len(data) % 8 == 0
    return is_der_key(data) or is_ssh_key(data)


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's private container, or a public key in wire format: length-prefixed fields that fill the data."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
        least = 3
    else:
        least = 2
        if not re.match(rb"\0\0\0[\x07-\x40](ssh-|ecdsa-|sk-ssh-)", data):
            return False
    at = fields = 0
    while at + 4 <= len(data) and fields < 64:
        size = int.from_bytes(data[at : at + 4])
        if least == 3 and fields == 3:  # the private container counts its keys here
            at, fields = at + 4, fields + 1
            continue
        at += 4 + size
        fields += 1
    return at == len(data) and fields >= least


def is_jwt(text: str) -> bool:
    """The first part is a JSON object with an algorithm. A header nested deeper than the parser goes is no token's."""
    header = unbase64(text.split(".")[0])
    try:
        return header is not None and isinstance(parsed := json.loads(header), dict) and isinstance(parsed.get("alg"), str)
    except (ValueError, RecursionError):
        return False


def pem_blocks(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, headers, body) of armoured blocks, from left to right, none inside another. Header lines and bodies that
    several BEGIN marks lead to are walked once, so the time grows with the text."""
    out = []
    first = last = -1  # the header lines walked last
    body_from = body_to = -1
    begin = PEM_BEGIN.search(text)
    while begin:
        start = at = begin.end()
        walked = lambda at: first <= at <= last and text[at - 1] == "\n"  # noqa: B023, E731
        while not walked(at) and (line := PEM_HEADER.match(text, at)):
            at = line.end()
        at = last if walked(at) else at
        first, last = start, at
        if at != body_from:
            body_from, body_to = at, PEM_BODY.match(text, at).end()
        end = body_to
        if (end > at or (at == start and text[at - 1].isspace())) and text.startswith(f"-----END {begin[1]}-----", end):
            end += len(begin[1]) + 14
            out.append((begin.start(), end, text[start:at], text[at:body_to]))
            begin = PEM_BEGIN.search(text, end)
        else:
            begin = PEM_BEGIN.search(text, start)
    return out


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Places of three parts joined by dots, the first from an ``ey`` or ``ew`` at a word's start on. Each part is read as first part
    once, whatever marks it holds."""
    out = []
    parts = TOKEN_PARTS.search(text)
    while parts:
        start = TOKEN_START.search(text, parts.start(1), parts.end(1))
        if start and parts.end(1) - start.start() >= 8:
            out.append((start.start(), parts.end()))
            parts = TOKEN_PARTS.search(text, parts.end())
        else:
            parts = TOKEN_PARTS.search(text, parts.end(1))
    return out


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, sorted."""
    out: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    structural: list[tuple[int, int, int]] = []
    if "-----BEGIN " in text:
        structural += [(a, 3, b) for a, b, headers, body in pem_blocks(text) if is_pem_secret(headers, body)]
    if max(map(len, text.split()), default=0) >= MIN_STRETCH:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        structural += [(a, 4, b) for a, b in signed_tokens(text) if is_jwt(text[a:b])]
        taken = sorted((a, b) for a, _, b in structural)
        at = reach = 0
        for m in BASE64.finditer(text):
            while at < len(taken) and taken[at][0] <= m.start():
                reach = max(reach, taken[at][1])
                at += 1
            if m.start() < reach:
                continue
            data = unbase64(m[0])
            if data and is_ssh_key(data):
                structural.append((m.start(), 5, m.end()))
            elif data and is_der_key(data):
                structural.append((m.start(), 6, m.end()))
        for m in HEX_ANY.finditer(text):
            data = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else b""
            if data and (is_der_key(data) or is_ssh_key(data)):
                structural.append((m.start(), 5 if is_ssh_key(data) else 6, m.end()))
    return sorted(set(out + structural))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of the base kinds, base_sha256, spans, n_<kind> of the structural kinds, redacted) for each row of docs.

    redacted is the text with every span replaced, null where nothing was found. Null and empty texts have no
    span; repeated rows return a row each; an empty table returns none. Spans that start together are listed in order of
    kinds; a structure inside an armoured block or a token is not listed again. Very long texts are searched whole, in
    time that grows with their length. Other columns of docs, whatever their names, are not read."""
    counts = lambda kinds: ", ".join(f"n_{k} long" for k in kinds)

    def run(batch: pa.RecordBatch) -> dict:
        texts = ["" if t is None else t for t in batch.column("_t").to_pylist()]
        found = [find_spans(t) for t in texts]
        out: dict = {"id": batch.column("id")}
        for n, kind in enumerate(KINDS):
            out[f"n_{kind}"] = [sum(k == n for _, k, _ in f) for f in found]
        out["base_sha256"] = [hashlib.sha256(listed([x for x in f if x[1] < len(BASE_KINDS)]).encode()).hexdigest() for f in found]
        out["spans"] = [listed(f) for f in found]
        out["redacted"] = [redact(t, f) if f else None for t, f in zip(texts, found)]
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"))
    return map_batches(
        rows, run, f"id long, {counts(BASE_KINDS)}, base_sha256 string, spans string, {counts(KINDS[len(BASE_KINDS) :])}, redacted string"
    )


def redacted_column(docs: DataFrame) -> Callable[[Column], Column]:
    """The text with its secrets replaced, as a function of a text column; null stays null."""
    limit_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def redacted(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redact(t, find_spans(t)) for t in text.to_pylist()], pa.string())

    return redacted
