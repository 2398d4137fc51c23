"""Benchmark decontamination: the q-gram lemma filters, banded alignment verifies.

Texts are folded (lower case, every run of blanks and punctuation as one blank).  A benchmark
item leaks into a document if some ``window`` characters of the item (all of it, if shorter)
occur in the document with at most ``ERROR`` of them edited.  Such a pair of windows of length
w with at most e edits shares at least w + 1 - q(e + 1) q-grams, all on diagonals at most e
apart.  So q-gram hits are counted in overlapping bands of diagonals, along the document;
where a band holds enough hits within the reach of one window, the region is aligned.

The items' q-grams are an index that every task holds, in blocks of at most ``BLOCK_CHARS``
characters; larger benchmarks are read block after block, so what is broadcast at once is
bounded.  Documents are never shuffled, and no pair of a document and an item is formed
unless they share q-grams on a diagonal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

Q = 9
WINDOW = 60
ERROR = 0.05
LEAST = 30  # shorter items are compared too, but without edits and whole
BLOCK_CHARS = 4_000_000
NO_WORD = re.compile(r"[\W_]+")
BAND = int(ERROR * WINDOW) + 1
SPAN = 200_000  # characters of documents looked at together
OUTSIDE = np.uint64(1 << 32)  # no character
ODD = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str | None) -> str:
    return NO_WORD.sub(" ", (text or "").lower()).strip()


def edits(length: int) -> int:
    """Edits allowed in a window of this length: none below LEAST."""
    return int(ERROR * length) if length >= LEAST else 0


def lemma(w: int, e: int, q: int = Q) -> int:
    """Q-grams that windows of length w with at most e edits share at least."""
    return w + 1 - q * (e + 1)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram of a sequence of code points."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, width = codes, 1
    while 2 * width <= q:  # hashes of twice the width
        h, width = h[:-width] * ODD + h[width:], 2 * width
        h ^= h >> np.uint64(29)
    while width < q:
        h, width = h[:len(codes) - width] * ODD + codes[width:], width + 1
    h ^= h >> np.uint64(29)
    return h * ODD


@dataclass(frozen=True)
class Index:
    ids: list
    texts: list[str]
    grams: np.ndarray  # sorted hashes
    items: np.ndarray  # of each hash
    places: np.ndarray
    sizes: np.ndarray  # of the folded texts
    short: list[int]  # items without a q-gram
    seen: np.ndarray  # bitmap of the hashes' top bits, to pass over most of a text quickly
    bits: int


def index(items: list[tuple[object, str | None]]) -> Index:
    """Q-gram index of (id, text) pairs; items with fewer than Q folded characters can only be found by equality."""
    ids, texts, grams, owner, place = [], [], [], [], []
    for i, text in items:
        text = folded(text)
        if text:
            h = gram_hashes(_codes(text))
            owner.append(np.full(len(h), len(ids), np.int64))
            place.append(np.arange(len(h)))
            grams.append(h)
            ids.append(i)
            texts.append(text)
    join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    g, o, p = join(grams, np.uint64), join(owner, np.int64), join(place, np.int64)
    order = np.argsort(g, kind="stable")
    bits = max(16, int(len(g)).bit_length() + 5)
    seen = np.zeros(1 << bits, bool)
    seen[g >> np.uint64(64 - bits)] = True
    return Index(ids, texts, g[order], o[order], p[order],
                 np.array([len(t) for t in texts], np.int64), [n for n, t in enumerate(texts) if len(t) < Q], seen, bits)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def hits(ix: Index, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place in item, place in text) of every shared q-gram."""
    h = gram_hashes(codes)
    at = np.flatnonzero(ix.seen[h >> np.uint64(64 - ix.bits)])
    lo = np.searchsorted(ix.grams, h[at], "left")
    n = np.searchsorted(ix.grams, h[at], "right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return ix.items[rows], ix.places[rows], np.repeat(at, n)


def regions(ix: Index, codes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first place, last place, diagonal) where a band reaches the lemma's bound.

    ``codes`` holds texts one after the other, ``ends`` where each of them ends.  Places are
    those of the hits that fill the bound; each row is worth an alignment around its diagonal.
    """
    item, place, at = hits(ix, codes)
    if not len(item):
        return []
    text = np.searchsorted(ends, at, side="right")
    w = np.minimum(ix.sizes, WINDOW)[item]
    e = np.where(w >= LEAST, (ERROR * w).astype(np.int64), 0)
    need = np.maximum(1, lemma(w, e))
    found = []
    for shift in (0, BAND):  # bands overlap by half, so e + 1 neighbouring diagonals lie in one
        band = (at - place + (1 << 40) + shift) // (2 * BAND)
        order = np.lexsort((at, band, item))
        d, i, b, t, k, reach = text[order], item[order], band[order], at[order], need[order], (w + e)[order]
        far = np.arange(len(i)) + k - 1  # the hit that would be the k-th, counted from this one
        ok = far < len(i)
        far = np.minimum(far, len(i) - 1)
        ok &= (d[far] == d) & (i[far] == i) & (b[far] == b) & (t[far] - t <= reach - Q)
        for x in np.flatnonzero(ok).tolist():
            row = [int(d[x]), int(i[x]), int(t[x]), int(t[far[x]]) + Q, int(b[x]) * 2 * BAND - (1 << 40) - shift + BAND]
            if found and found[-1][:2] == row[:2] and found[-1][4] == row[4] and row[2] <= found[-1][3]:
                found[-1][3] = max(found[-1][3], row[3])
            else:
                found.append(row)
    return [tuple(r) for r in sorted(found)]


def alignment(item: np.ndarray, text: np.ndarray, first: int, last: int, diagonal: int) -> int | None:
    """Least edits of a window of the item in a band around the diagonal, None if more than allowed.

    Windows of the item that meet the places first..last on the diagonal are aligned at once,
    one row each: a window may begin and end anywhere in its stretch of the text, which is the
    window's place on the diagonal and ``BAND`` plus the edits to either side.
    """
    w = min(WINDOW, len(item))
    limit = edits(w)
    slack = BAND + limit
    starts = np.arange(max(0, first - diagonal - w - slack), min(len(item) - w, last - diagonal + slack) + 1)
    if not len(starts):
        return None
    a = np.lib.stride_tricks.sliding_window_view(item, w)[starts]
    places = starts[:, None] + diagonal - slack + np.arange(w + 2 * slack)
    b = np.where((places >= 0) & (places < len(text)), text[np.clip(places, 0, len(text) - 1)], OUTSIDE)
    step = np.arange(b.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(a), b.shape[1] + 1), np.int32)  # least edits of the window's first i characters, ending at each place
    for i in range(w):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (a[:, i:i + 1] != b), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step  # insertions
        alive = row.min(1) <= limit
        if not alive.any():
            return None
        if not alive.all():
            a, b, row = a[alive], b[alive], row[alive]
    return int(row.min())


def leaks(ix: Index, texts: list[str | None]) -> list[tuple[int, object, int, int, int]]:
    """(number of the text, item id, start, end, edits) of each leak, in characters of the folded text.

    Neighbouring regions of one item in one text are one leak.  Items too short for a q-gram
    leak where they are whole words of the text.
    """
    low = [folded(t) for t in texts]
    codes = _codes("\0".join(low) + "\0")  # no folded text holds the separator
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    found: list[tuple[int, object, int, int, int]] = []
    for d, n, first, last, diagonal in regions(ix, codes, ends):
        base = int(ends[d]) - len(low[d]) - 1
        first, last = first - base, last - base
        if found and found[-1][:2] == (d, ix.ids[n]) and first <= found[-1][3]:
            found[-1] = (*found[-1][:3], max(last, found[-1][3]), found[-1][4])
            continue
        cost = alignment(_codes(ix.texts[n]), codes[base:base + len(low[d])], first, last, diagonal - base)
        if cost is not None:
            found.append((d, ix.ids[n], first, last, cost))
    for n in ix.short:
        mark = f" {ix.texts[n]} "
        for d, t in enumerate(low):
            if (at := f" {t} ".find(mark)) >= 0:
                found.append((d, ix.ids[n], at, at + len(mark) - 2, 0))
    return found


def batched_leaks(ix: Index, texts: list[str | None]) -> list[tuple[int, object, int, int, int]]:
    """The same, some hundred thousand characters at a time."""
    out, lo, size = [], 0, 0
    for i, t in enumerate([*texts, None]):
        if i == len(texts) or size > SPAN:
            out += [(lo + d, *rest) for d, *rest in leaks(ix, texts[lo:i])] if i > lo else []
            lo, size = i, 0
        size += len(t or "")
    return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Indexes of the benchmark's distinct texts, at most BLOCK_CHARS characters each, one after the other."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    block, chars = [], 0
    for r in rows.toLocalIterator():
        if block and chars + len(r["text"]) > BLOCK_CHARS:
            yield index(block)
            block, chars = [], 0
        block.append((r["id"], r["text"]))
        chars += len(r["text"])
    yield index(block)


def found_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits), a row per leaking region; clean documents give none.

    Null and empty texts and items leak nothing; repeated rows give their leaks as often.
    """
    kind, item = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType
    sc = docs.sparkSession.sparkContext
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for ix in blocks(benchmark):
        part = slim.mapInArrow(_finder(sc.broadcast(ix), to_arrow_type(item)), f"doc_id {kind}, item_id {item.simpleString()}, start long, end long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def _finder(shared, item: pa.DataType):
    def run(batches):
        for b in batches:
            rows = batched_leaks(shared.value, b.column(1).to_pylist())
            at, ids, *numbers = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(ids, item), *[pa.array(n, pa.int64()) for n in numbers]],
                ["doc_id", "item_id", "start", "end", "edits"])
    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text leaks no item, unchanged; the text is judged row by row, so ids may be null or repeated."""
    sc = docs.sparkSession.sparkContext
    shape = docs.select(text_col, *[c for c in docs.columns if c != text_col])
    for ix in blocks(benchmark):
        shape = shape.mapInArrow(_keeper(sc.broadcast(ix)), shape.schema)
    return shape.select(*docs.columns)


def _keeper(shared):
    def run(batches):
        for b in batches:
            leaking = {at for at, *_ in batched_leaks(shared.value, b.column(0).to_pylist())}
            yield b.filter(pa.array([i not in leaking for i in range(b.num_rows)], pa.bool_()))
    return run
