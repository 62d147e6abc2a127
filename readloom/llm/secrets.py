"""Secret scans: pattern spans, and assignment-aware lexing with constant propagation.

The lexer turns source and configuration syntax (quoted keys, subscripts, `:` `=` `:=` `=>`, bare
values at a line's end, triple quotes, shell references, arguments of calls) into name-literal pairs. A name bound to a literal is a constant; where a later
target takes that name, alone or joined by `+`, the literals flow to the target. Each literal is scored by
the most sensitive target name that it reaches, times how much it looks like a value.

Defined results: null and empty texts have no spans (`base_sha256` of the empty string); repeated rows
each give their own row; null doc_ids are kept; further columns are not read, whatever their names;
of literals with one span the highest score is told; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import ship

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{24}")
BASE_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive a part of a target name is.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 0.9, "auth": 0.6}
#: The letters of a text hold one of these wherever a target name is sensitive: parts are joined over anything but letters.
NAME_HINTS = tuple(x.encode() for x in SENSITIVE if not any(y != x and y in x for y in SENSITIVE))
NO_LETTERS = bytes(x for x in range(256) if not chr(x).isascii() or not chr(x).isalpha())
LITERAL_SCORE = 0.6

TOKEN = re.compile(
    r"""(?P<str>\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<ref>\$\{[A-Za-z_][A-Za-z0-9_]*\}|\$[A-Za-z_][A-Za-z0-9_]*)|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)|(?P<op>:=|=>|==|!=|<=|>=|[:=+\[\],;(){}])|(?P<nl>\n)|(?P<num>[0-9][A-Za-z0-9_.+/=-]*)|(?P<sp>[^\S\n]+)|(?P<other>.)""",
    re.A | re.S,
)
REF = re.compile(r"\$\{[A-Za-z_][A-Za-z0-9_]*\}|\$[A-Za-z_][A-Za-z0-9_]*", re.A)
BARE = re.compile(r"[^\s\"'#;,(){}\[\]<>]{6,}")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def name_score(name: str) -> float:
    """The sensitivity of a target name: of its parts, and of neighbours joined (api_key, privateKey)."""
    parts = [x.lower() for x in CAMEL.findall(name)]
    joined = parts + ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    return max((SENSITIVE.get(x, 0.0) for x in joined), default=0.0)


def value_score(value: str) -> float:
    """How much a literal looks like a secret rather than a word or a placeholder: length, kinds of characters, entropy per character."""
    n = len(value)
    if n < 6 or any(x.isspace() for x in value) or len(set(value)) < 4:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum((any(x.islower() for x in value), any(x.isupper() for x in value), any(x.isdigit() for x in value), any(not x.isalnum() for x in value)))
    return min(1.0, 0.35 + 0.1 * kinds + min(bits, 4.5) / 4.5 * 0.35 + min(n, 20) / 20 * 0.1)


def _inner(word: str) -> int:
    """The width of a string's quotes."""
    return 3 if len(word) >= 6 and word[:3] in ('"""', "'''") else 1


def _read(token: tuple, literals: list, names: list) -> None:
    """A string, or a name that is used; a string that is one reference uses its name."""
    kind, word, start, end = token
    if kind != "str":
        names.append(word.strip("${}"))
    elif REF.fullmatch(inner := word[_inner(word) : -_inner(word)]):
        names.append(inner.strip("${}"))
    else:
        literals.append((start + _inner(word), end - _inner(word)))


def _arguments(tokens: list[tuple], j: int, literals: list, names: list) -> int:
    """Read a call's arguments from its first; the place of its closing bracket, or of what ends the reading: the line's end, or a keyword that is a target itself."""
    depth = 1
    while j < len(tokens):
        kind, word, _, _ = tokens[j]
        depth += (word in "([{") - (word in ")]}") if kind == "op" else 0
        if not depth or kind == "nl":
            break
        if kind in ("str", "name", "ref"):
            if j + 1 < len(tokens) and tokens[j + 1][1] in ("=", ":", ":=", "=>"):
                break
            _read(tokens[j], literals, names)
        j += 1
    return j


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """(target name, spans of literals, names used) of each assignment, in text order."""
    tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(text) if m.lastgroup != "sp"]
    n, i = len(tokens), 0
    while i < n:
        kind, word, _, _ = tokens[i]
        j = i + 1
        if kind not in ("name", "ref", "str"):
            i = j
            continue
        target = word[_inner(word) : -_inner(word)] if kind == "str" else word.strip("${}")
        if kind == "name" and j + 2 < n and tokens[j][1] == "[" and tokens[j + 1][0] == "str" and tokens[j + 2][1] == "]":
            target, j = f"{target}.{tokens[j + 1][1][1:-1]}", j + 3
        if kind == "name" and j + 1 < n and tokens[j][1] == ":" and tokens[j + 1][0] == "name" and j + 2 < n and tokens[j + 2][1] == "=":
            j += 2  # an annotated name
        if j >= n or tokens[j][1] not in (":", "=", ":=", "=>"):
            i += 1
            continue
        literals, names, j, called = [], [], j + 1, False
        while j < n:
            kind, word, start, end = tokens[j]
            if kind in ("str", "ref"):
                _read(tokens[j], literals, names)
            elif kind == "name":
                _read(tokens[j], literals, names)
                if j + 1 < n and tokens[j + 1][1] == "(":
                    j, called = _arguments(tokens, j + 2, literals, names), True
                    if j >= n or tokens[j][1] != ")":
                        break
                elif m := BARE.match(text, start):  # a bare value of a configuration line
                    if m.end() > end or any(x.isdigit() for x in word):
                        literals.append((start, m.end()))
                        while j + 1 < n and tokens[j + 1][2] < m.end():
                            j += 1
            elif kind == "num" and (m := BARE.match(text, start)):
                literals.append((start, m.end()))
                while j + 1 < n and tokens[j + 1][2] < m.end():
                    j += 1
            else:
                break
            if j + 1 < n and tokens[j + 1][1] == "+":
                j += 2
                continue
            j += 1
            break
        yield target, literals, names
        i = max(i + 1, j - 1 if names and not literals and not called else j)


def lexed(text: str) -> list[tuple[int, int, float]]:
    """Spans (start, end, score) of literals that reach a sensitive name, directly or through constants.

    A use of a name means its latest assignment before, so sensitivity flows from the last assignment back to the first, once each."""
    latest: dict[str, int] = {}
    found: list[tuple[float, list[tuple[int, int]], list[int]]] = []
    for target, literals, names in pairs(text):
        used = [latest[name] for name in names if name in latest]
        latest[target] = len(found)
        found.append((name_score(target), literals, used))
    reached = [x[0] for x in found]
    best: dict[tuple[int, int], float] = {}
    for i in range(len(found) - 1, -1, -1):
        _, literals, used = found[i]
        for j in used:
            reached[j] = max(reached[j], reached[i])
        for span in literals if reached[i] else ():
            if (score := reached[i] * value_score(text[span[0] : span[1]])) > best.get(span, 0.0):
                best[span] = score
    return [(a, b, s) for (a, b), s in best.items() if s >= LITERAL_SCORE]


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every span of a text, by start, then kind; code points, end exclusive."""
    if not text:
        return []
    low, found = text.lower(), []
    if any(x in low for x in BASE_HINTS):
        found += [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if HEX_RUN.search(text):
        found += [("hex", *m.span(), 1.0) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    letters = text.encode("utf-8", "surrogatepass").translate(None, NO_LETTERS).lower()
    if any(x in letters for x in NAME_HINTS):
        found += [("literal", *x) for x in lexed(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, top_score double, base_sha256 string, spans string"


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            found = scan(text)
            n = Counter(x[0] for x in found)
            told = [f"{k}:{a}:{b}" for k, a, b, _ in found]
            base = ",".join(x for x in told if not x.startswith("literal"))
            rows.append((n["assign"], n["access"], n["hex"], n["literal"], max((x[3] for x in found), default=0.0), hashlib.sha256(base.encode()).hexdigest(), ",".join(told)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the pattern spans, and all spans."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, SCHEMA)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
