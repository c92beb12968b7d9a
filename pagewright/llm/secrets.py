"""Secrets in texts, by lexing what looks like source code or configuration.

Three patterns give the base spans. Assignment-aware lexing adds to them: a text is read as a stream of names, assignment signs,
literals and joining signs, from which (name, value) pairs are parsed as source and configuration languages
write them: ``name = "x"``, ``name: x``, ``"name": "x"``, ``name => "x"``, ``NAME=x``, ``--name=x``, ``name := "x"``. A
value is one or more literals and names joined with ``+`` or ``.``. Names with values are constants: where a later
or earlier assignment uses one, its literals are traced back. A literal is a secret if some name it reaches is
sensitive enough and the literal looks like key material.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.common import keyed, public_id, text_slices

#: The base kinds in their order, with what a match must have.
_KIND_ORDER = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LEAST = {"assign": 6, "access": 20, "hex": 24}

#: How much a part of a name says that its value is secret, and what takes it back.
_SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
              "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8,
              "private": 0.4, "access": 0.3, "api": 0.3, "signing": 0.4, "encryption": 0.4, "client": 0.2, "key": 0.5}
_HARMLESS = {"id", "name", "url", "uri", "path", "file", "type", "length", "len", "count", "size", "public", "expires",
             "expiry", "ttl", "regex", "pattern", "format", "label", "field", "header", "prompt", "hint", "error", "message"}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|0+|changeme|change_me|example|password|secret|token|none|null|true|false|undefined|todo|test|"
    r"your[-_ ].*|<.*>|\$\{.*\}|\$\(.*\)|\{\{.*\}\}|%\(.*\)s|\$[A-Za-z_]\w*)$")
#: A literal is a span from this score on: name score times literal score.
SCORE, LEAST_CHARS = 0.4, 6

_NAME = r"[A-Za-z_$][\w$]{0,255}(?:(?:\.|->|::|-)[A-Za-z_$][\w$]{0,255}){0,15}"
_QUOTED = "|".join(rf"{q}[^{q}\\\n]*(?:\\.[^{q}\\\n]*)*{q}" for q in "\"'`")
#: A sign that assigns: no comparison, no scheme (``://``), no part of a longer operator.
_SIGN = re.compile(r"(?<![=!<>:+*/%&|^~-])(?::=|=>|[:=](?![=:]|//))")
#: What stands before a sign, read backwards from it: a quoted name or a plain one.
_BEFORE = re.compile(r"""[ \t]{0,64}(?:\]?(["'`])([^"'`\n]{1,256})\1|([\w$][\w$.:>-]{0,511}))""", re.A)
_PLAIN = r"[^\s\"'`,;#(){}\[\]<>=&]"
_VALUE = re.compile(rf"""[ \t]*(?:(?P<literal>{_QUOTED})|(?P<name>{_NAME})(?!{_PLAIN}|[(=])|(?P<bare>{_PLAIN}+={{0,2}}))""", re.A)
_JOIN = re.compile(r"[ \t]*(?:\+|\.(?=[ \t]*[\"'$])|\\\n)")
_END = re.compile(r"[ \t]*(?:[+.\n;,)}\]#]|//|\Z)")
_WORD_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)
#: Characters before a sign that may hold its name.
_REACH = 600


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, leftmost and without overlaps per kind; short matches are dropped."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= _LEAST["hex"]]
    return out


def name_score(name: str) -> float:
    """0 to 1: how likely the value of a name is secret, from the words it is made of."""
    parts = [p.lower() for p in _WORD_PARTS.findall(name)]
    if not parts or parts[-1] in _HARMLESS:
        return 0.0
    joined = {a + b for a, b in zip(parts, parts[1:])}
    return min(1.0, sum(_SENSITIVE.get(p, 0.0) for p in set(parts) | joined))


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks like key material: length, variety of characters, no blanks, no placeholder."""
    if len(value) < LEAST_CHARS or _PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    if "://" in value and "@" not in value or value[0] in "/~" and "." in value:
        return 0.0
    sample = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in sample.values())
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, entropy / 4 * (0.5 + kinds / 4))


def _name_before(text: str, at: int) -> str | None:
    m = _BEFORE.match(text[max(0, at - _REACH):at][::-1])
    if not m:
        return None
    return (m[2] or m[3])[::-1].lstrip("-.:>") or None


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, literal spans, names used) of every assignment of a text, in order.

    A plain word as the whole value may be a name or, as configuration files have it, a literal without quotes: it is given as both.
    """
    out, inside = [], 0
    for sign in _SIGN.finditer(text):
        if sign.start() < inside:
            continue  # a sign inside a value without quotes is part of it
        name = _name_before(text, sign.start())
        if name is None:
            continue
        spans, used, at = [], [], sign.end()
        while m := _VALUE.match(text, at):
            at = m.end()
            if m["literal"]:
                spans.append((m.start("literal") + 1, at - 1))
            elif m["bare"]:
                spans.append(m.span("bare"))
                inside = at
                break
            else:
                used.append(m["name"])
                if not _END.match(text, at):
                    break  # the first word of a sentence
                spans.append(m.span("name"))
            join = _JOIN.match(text, at)
            if not join:
                break
            at = join.end()
        if spans or used:
            out.append((name, spans, used))
    return out


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that a sensitive name gets, directly or through constants."""
    found = pairs(text)
    if not found:
        return []
    key = lambda name: name.replace("->", ".").replace("::", ".").rpartition(".")[2].lower()
    known = {key(n) for n, *_ in found}
    scores: dict[str, float] = {}
    users: dict[str, list[str]] = {}
    for name, _, used in found:
        k = key(name)
        scores[k] = max(scores.get(k, 0.0), name_score(name))
        for u in used:
            if key(u) in known and key(u) != k:
                users.setdefault(k, []).append(key(u))
    # a constant is as sensitive as the most sensitive name its value reaches; every name is passed on once
    for k in sorted(scores, key=lambda k: -scores[k]):
        waiting = [k]
        while waiting:
            for u in users.pop(waiting.pop(), ()):
                scores[u] = max(scores[u], scores[k])
                waiting.append(u)
    out = set()
    for name, spans, used in found:
        constants = {key(u) for u in used if key(u) in known}
        for start, end in spans:
            value = text[start:end]
            if key(value) in constants:
                continue  # a name, not a literal
            if scores[key(name)] * literal_score(value) >= SCORE:
                out.add((start, end))
    return sorted(out)


def find(text: str) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256 and all spans of a text."""
    base = base_spans(text)
    said = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in
                                  sorted(spans, key=lambda x: (x[0], _KIND_ORDER.index(x[2]), x[1])))
    count = Counter(k for *_, k in base)
    added = [(s, e, "literal") for s, e in literal_spans(text)]
    return (count["assign"], count["access"], count["hex"], hashlib.sha256(said(base).encode()).hexdigest(),
            said(base + added))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``, from the whole text.

    Spans are kind:start:end in code points, end exclusive, by start, then kind: the three base kinds and
    ``literal``, the literals that a sensitive name gets. A literal may lie inside a base span; both are given. Null and empty texts have none. Every
    row is judged by itself, repeated rows and null ids included; an empty table gives an empty result. Other columns are
    ignored. Names have
    at most 512 characters. Nothing is shuffled; memory is bounded by the longest text.
    """
    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch, "_text", as_bytes=False):
                rows = list(zip(*map(find, texts)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(first, len(texts)),
                     *(pa.array(c, pa.int64()) for c in rows[:3]), *(pa.array(c, pa.string()) for c in rows[3:])],
                    ["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = keyed(docs).drop("_th").mapInArrow(
        run, "_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.select(public_id().alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
