"""Secrets: base patterns, and literals that assignments bind to sensitive names.

The lexer finds assignments in source and configuration syntax: a name with its subscripts and
annotation, an operator (``=``, ``:=``, ``:``, ``=>``), an expression.  JSON and YAML keys, XML elements
and attributes, parameter defaults, ``export`` and look-ups with a default (``getenv("PWD", "...")``) are
assignments too.  An expression is read token by token: strings of all quotes and prefixes, bare
literals, names, joined by ``+``, ``.`` or by standing side by side, in lists and calls.

Constants propagate both ways in a text: a name used in a sensitive expression makes all its
definitions sensitive, wherever they stand, and names joined in one expression are scored together.
A literal's score is the weight of the most sensitive target it reaches, times its randomness; what
reaches ``THRESHOLD`` becomes a span of kind ``named``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base patterns. ASCII bytes, so that case folding stays within A-Z.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "named")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

# How sensitive the parts of a target name are.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0,
    "accesskey": 0.9, "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "authorization": 0.7, "auth": 0.6, "signature": 0.5,
    "salt": 0.5, "pin": 0.3, "key": 0.4,
}
# Literals that only stand for a secret.
PLACEHOLDERS = {"changeme", "example", "password", "placeholder", "redacted", "undefined", "yourpassword", "none", "null", "true", "false"}
THRESHOLD = 0.45
LEAST_LITERAL = 8

STRING = (rb"(?<![A-Za-z0-9_])[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|\x27\x27\x27(?:[^\\]|\\.)*?\x27\x27\x27"
          rb"|\"(?:[^\"\\\n]|\\.)*+\"|\x27(?:[^\x27\\\n]|\\.)*+\x27|`(?:[^`\\]|\\.)*+`)")
NAME = rb"[A-Za-z_][A-Za-z0-9_.-]*+"
TYPE = rb"[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\]\n=]{0,99}\])?(?:[\x20\t]*+\|[\x20\t]*+[A-Za-z_][A-Za-z0-9_.]*+)*+[?]?"
#: What is assigned to: a name, quoted or not, subscripts with a quoted key, an annotation, the operator.
TARGET = re.compile(
    rb"(?<![A-Za-z0-9_.-])[\"']?(" + NAME + rb")[\"']?((?:\[[\x20\t]*+[\"'][^\"'\]\n]{0,200}[\"'][\x20\t]*+\])*+)[\x20\t]*+"
    rb"(?::[\x20\t]*+" + TYPE + rb"[\x20\t]*+=(?![=>])|:=|=>|=(?![=>])|:(?![:=]))")
#: A look-up by a quoted name; what follows is the default.
LOOKUP = re.compile(rb"(?:getenv|get|getProperty|env|fetch|config)\([\x20\t]*+[\"'](" + NAME + rb")[\"'][\x20\t]*+,")
ELEMENT = re.compile(rb"<([A-Za-z_][A-Za-z0-9_.:-]*+)[^<>\n]{0,500}>([^<>]++)</\1>")
TOKEN = re.compile(rb"[\x20\t]*+(?:(" + STRING + rb")|([A-Za-z0-9/_$-](?:[A-Za-z0-9+/_.=$-]*[A-Za-z0-9+/_=$-])?)|([+,.\[({\])}]))", re.S)
GAP = re.compile(rb"\s*+")
PART = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
IDENTIFIER = re.compile(rb"[A-Za-z_][A-Za-z0-9_.]*")
SIGN = re.compile(rb"[=:]")
SENSITIVE = re.compile(rb"passw|passphrase|pwd|secret|token|key|credential|bearer|auth|signature|salt|pin", re.I)
DEEPEST = 50  # brackets of one expression


@dataclass(frozen=True)
class Span:
    kind: str
    start: int  # code points
    end: int
    score: float


def sensitivity(name: bytes) -> float:
    """Weight of the most sensitive part, or pair of neighbouring parts, of a name."""
    parts = [p.decode().lower() for p in PART.findall(name)]
    both = parts + [a + b for a, b in zip(parts, parts[1:])]
    return max((WEIGHTS.get(p, 0.0) for p in both), default=0.0)


def randomness(literal: bytes) -> float:
    """0 to 1: bits per character against what a secret of this length would have; plain words have none."""
    n = len(literal)
    if n < LEAST_LITERAL or literal.lower().decode("latin1") in PLACEHOLDERS or len(set(literal)) < 4:
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in (rb"[0-9]", rb"[A-Z]", rb"[a-z]", rb"[^A-Za-z0-9]"))
    if kinds == 1 and n < 16 or re.fullmatch(rb"[A-Za-z]?[a-z]+(?:[\x20_.,-]+[a-z]+)*", literal):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, bits / math.log2(min(n, 64))) * (1.0 if kinds > 1 else 0.5)


def base_spans(data: bytes) -> list[tuple[str, int, int]]:
    """Byte spans of the base kinds; the checks follow the search, so a failing match still uses its text up."""
    found = []
    if SIGN.search(data):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in data:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(data)]


@dataclass(frozen=True)
class Term:
    start: int
    end: int
    name: bytes | None  # of a bare word that may be a constant's name


@dataclass
class Binding:
    """An assignment: its names, the parts of its expression, each a run of terms joined together, and how sensitive it is."""
    names: list[bytes]
    runs: list[list[Term]]
    weight: float = 0.0


def expression(data: bytes, at: int) -> list[list[Term]]:
    """The runs of joined terms of the expression that starts here; a list or call holds several."""
    runs: list[list[Term]] = [[]]
    depth, joined = 0, True
    while m := TOKEN.match(data, GAP.match(data, at).end() if depth else at):
        string, bare, sign = m[1], m[2], m[3]
        if sign is None and not joined and not (string and runs[-1] and depth == 0 and runs[-1][-1].name is None):
            break  # a term behind a term, unless strings stand side by side
        at, start = m.end(), m.start(1) if string is not None else m.start(2)
        if string is not None:
            quote = len(string) - len(string.lstrip(b"rRbBuUfF"))
            width = 3 if string[quote:quote + 3] in (b'"""', b"\x27\x27\x27") else 1
            runs[-1].append(Term(start + quote + width, m.end(1) - width, None))
            joined = False
        elif bare is not None:
            plain = IDENTIFIER.fullmatch(bare)
            runs[-1].append(Term(start, m.end(2), bare if plain else None))
            joined = False
            if data[at:at + 1] in (b"(", b"[") and plain:  # a call or an item: its name is no value
                runs[-1].pop()
                joined = True
        elif sign in b"[({":
            if not joined or depth >= DEEPEST:
                break
            depth += 1
            runs.append([])
        elif sign in b"])}":
            if not depth:
                break
            depth, joined = depth - 1, False
            if not depth:
                runs.append([])
        elif sign == b",":
            if not depth:
                break
            runs.append([])
            joined = True
        else:
            joined = True  # + and . join
    return [r for r in runs if r]


def bindings(data: bytes) -> list[Binding]:
    found = []
    for m in TARGET.finditer(data):
        keys = re.findall(rb"[\"']([^\"'\]\n]*)[\"']", m[2]) if m[2] else []
        found.append(Binding([m[1], *keys], expression(data, m.end()), max(map(sensitivity, (m[1], *keys)))))
    found += [Binding([m[1]], expression(data, m.end()), sensitivity(m[1])) for m in LOOKUP.finditer(data)]
    for m in ELEMENT.finditer(data):
        text = m[2].strip()
        start = m.start(2) + m[2].index(text) if text else m.start(2)
        found.append(Binding([m[1]], [[Term(start, start + len(text), None)]], sensitivity(m[1])))
    return found


def named_spans(data: bytes) -> list[tuple[int, int, float]]:
    """Byte spans (start, end, score) of literals that reach a sensitive name, directly or through constants."""
    if not SENSITIVE.search(data) or not (SIGN.search(data) or b"<" in data or b"," in data):
        return []
    every = bindings(data)
    defined: dict[bytes, list[Binding]] = {}
    for b in every:
        if len(b.names) == 1:
            defined.setdefault(b.names[0], []).append(b)
    # a name is passed on once for each greater weight that reaches it, and there are few weights
    reached: dict[bytes, float] = {}
    todo = [b for b in every if b.weight]
    while todo:
        b = todo.pop()
        for name in {t.name for run in b.runs for t in run if t.name in defined}:
            if reached.get(name, 0.0) < b.weight:
                reached[name] = b.weight
                for d in defined[name]:
                    if d.weight < b.weight:
                        d.weight = b.weight
                        todo.append(d)
    score: dict[tuple[int, int], float] = {}
    for b in every:
        for run in b.runs if b.weight else ():
            literals = [t for t in run if _literal(t, defined)]
            joined = [x for t in run for x in ([t] if _literal(t, defined) else _only(defined, t))]
            for pieces in (literals, joined)[:1 if len(literals) == len(run) else 2]:
                value = b.weight * randomness(b"".join(data[t.start:t.end] for t in pieces))
                if value >= THRESHOLD:
                    for t in pieces:
                        if t.end > t.start:
                            score[t.start, t.end] = max(score.get((t.start, t.end), 0.0), value)
    return [(a, z, w) for (a, z), w in score.items()]


def _literal(t: Term, defined: dict[bytes, list[Binding]]) -> bool:
    """A bare word is a literal if it is no constant and holds a digit."""
    return t.name is None or t.name not in defined and re.search(rb"[0-9]", t.name) is not None


def _only(defined: dict[bytes, list[Binding]], t: Term) -> list[Term]:
    """The literals of a name that is defined once, as one run of literals."""
    d = defined.get(t.name, ())
    if len(d) == 1 and len(d[0].runs) == 1 and len(d[0].runs[0]) < 9 and all(_literal(x, defined) for x in d[0].runs[0]):
        return d[0].runs[0]
    return []


def find(text: str | None) -> list[Span]:
    """All spans by start, then kind. A null text is empty. Named literals inside a base span are not repeated."""
    data = (text or "").encode("utf-8", "surrogatepass")
    base = base_spans(data)
    extra = [("named", a, b, s) for a, b, s in named_spans(data) if not any(x <= a and b <= y for _, x, y in base)]
    spans = [(k, a, b, 1.0) for k, a, b in base] + extra
    if not spans:
        return []
    if len(data) == len(text):  # ASCII: a byte is a character
        at = lambda i: i
    else:
        place, seen, last = {}, 0, 0
        for i in sorted({x for s in spans for x in s[1:3]}):
            seen += len(data[last:i].decode("utf-8", "surrogatepass"))
            place[i], last = seen, i
        at = place.__getitem__
    return sorted((Span(k, at(a), at(b), s) for k, a, b, s in spans), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans become one mark."""
    out, end = [], 0
    for s in find(text):
        if s.start >= end:
            out += [text[end:s.start], mark]
        end = max(end, s.end)
    return "".join(out) + text[end:] if end else text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (kind, start, end, score)), a row per document, repeated ids and null ids included.

    Row-local: nothing is shuffled, and a text is held once per task.
    """
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            rows = [[vars(s) for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, item)], ["doc_id", "spans"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets in the text replaced by a mark; null texts stay null."""
    order = docs.columns
    others = [c for c in order if c != text_col]

    def run(batches):
        for b in batches:
            texts = [redact(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *b.columns[1:]], names=b.schema.names)
    shape = docs.select(text_col, *others)
    return shape.mapInArrow(run, shape.schema).select(*order)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and hash of the base spans, all spans as text, and how many were added by names."""
    found = scan(docs)
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind != "named")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"), count("named"))
