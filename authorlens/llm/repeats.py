"""Repeated passages by prefix-partitioned suffix trees over words.

A word is covered if a window of ``WIDTH`` words around it also starts earlier in the corpus.  In
the tree of all suffixes these windows are the paths to internal nodes of at least that depth.

1. Texts of equal words are one; all but the first are covered whole.
2. Of every window the least hash of its ``GRAM``-word runs is its anchor.  Equal windows have equal
   anchors at equal places, so windows whose anchor occurs once are no repeat.  Only about a
   seventh of the places are anchors; of the rest of the text, just the words of windows that may
   repeat go on, as 64-bit codes.
3. Suffixes, as deep as a window, are dealt out by prefixes of variable length: a prefix that more
   than ``group`` suffixes share is made longer, until its group fits in memory.  A group is sorted,
   common prefixes of neighbours give the deep internal nodes, and all but a node's first suffix
   are covered.  A window that is itself too frequent is dealt by salt and its firsts meet again.
4. Covered windows return to their document and merge into spans, the maximal repeats in it.

What a task holds at once of equal anchors or windows is reduced to one before it is shuffled, so
a passage in a third of all documents costs one row a task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from authorlens.llm.tokens import Memo
from authorlens.operators.joins import lookup
from authorlens.session import cut_lineage

WIDTH = 20
GRAM = 8
DEPTHS = ((1, 2), (3, 4), (6, 9), (14, None))  # lengths of prefixes counted in one pass; None is a whole window
REMEMBERED = 100_000  # words
ODD, MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LAST = (1 << 63) - 1  # stands for a null id, behind all others


@dataclass(frozen=True)
class Sizes:
    group: int = 300_000  # suffixes of a group, and anchors or covered windows that one task sorts
    chunk: int = 250_000  # words, anchors or suffixes that a task looks at together


# ------------------------------------------------------------------ words of texts

def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # of bytes: at \x20 and \x09-\x0D only


def _code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(31))) * ODD + b
    return (h ^ (h >> np.uint64(29))) * MORE


def run_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n codes, put together from runs of powers of two."""
    many = len(codes) - n + 1
    if many <= 0:
        return np.empty(0, np.uint64)
    whole, done, part, width = None, 0, codes, 1
    while width <= n:
        if n & width:
            piece = part[done:done + many]
            whole, done = piece if whole is None else _pair(whole, piece), done + width
        if 2 * width <= n:
            part = _pair(part[:-width], part[width:])
        width *= 2
    return whole


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of every ``span`` neighbouring hashes, the leftmost of equal ones."""
    many = len(grams) - span + 1
    if many <= 0:
        return np.empty(0, np.int64)
    least, width = grams, 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:many], least[span - width:span - width + many])
    step = np.zeros(many, np.int64)
    for j in range(span - 1, -1, -1):
        step[grams[j:j + many] == least] = j
    return np.arange(many) + step


class Piece:
    """Codes of some texts one after the other, and what their windows are."""

    def __init__(self, words: list[list[bytes]], memo: Memo, width: int):
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.counts)
        self.codes = np.fromiter((memo[w] for ws in words for w in ws), np.uint64, int(self.counts.sum()))
        self.owner = np.repeat(np.arange(len(words)), self.counts)
        gram = min(GRAM, width)
        self.grams = run_hashes(self.codes, gram)
        self.places = anchors(self.grams, width - gram + 1)  # of each window
        self.windows = np.flatnonzero(self.owner[:len(self.places)] == self.owner[width - 1:])  # those within one text


def pieces(texts: list[bytes], width: int, memo: Memo, chunk: int) -> Iterator[tuple[int, list[list[bytes]], Piece]]:
    """(number of the first text, words of the texts, their piece), about ``chunk`` words at a time."""
    some, size, lo = [], 0, 0
    for i, text in enumerate(texts):
        some.append(words_of(text))
        size += len(some[-1])
        if size >= chunk:
            yield lo, some, Piece(some, memo, width)
            some, size, lo = [], 0, i + 1
    if some:
        yield lo, some, Piece(some, memo, width)


def _binary(parts) -> pa.Array:
    return pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())


def _joined(column, kind) -> np.ndarray:
    """All values of a column of packed arrays, one after the other."""
    return np.frombuffer(b"".join(v for v in column.to_pylist() if v), kind)


def marks(docs: DataFrame, width: int, id_col: str, text_col: str, sizes: Sizes = Sizes()) -> DataFrame:
    """(doc_id, text_sha, words_sha, tie, n_words, anchors) of every row; ``tie`` orders texts of one id as their hash does."""
    def run(batches):
        memo = Memo(_code, REMEMBERED)
        for b in batches:
            for lo, words, piece in pieces(b.column(2).to_pylist(), width, memo, sizes.chunk):
                at = np.unique(piece.places[piece.windows])
                cuts = np.searchsorted(at, np.concatenate(([0], piece.ends)))
                sha = [hashlib.sha256(b" ".join(w)).digest() for w in words]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(words)), b.column(1).slice(lo, len(words)), pa.array(sha, pa.binary()), pa.array(map(_tie, sha), pa.int64()),
                     pa.array(piece.counts), _binary(piece.grams[at[x:y]] for x, y in zip(cuts, cuts[1:]))],
                    ["doc_id", "text_sha", "words_sha", "tie", "n_words", "anchors"])
    return _keyed(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, text_sha binary, words_sha binary, tie long, n_words long, anchors binary")


def _carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_keyed`` with the text compressed, for joins that shuffle it."""
    def run(batches):
        pack = zstandard.ZstdCompressor().compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(pack, b.column(2).to_pylist()), pa.binary())], ["doc_id", "text_sha", "text"])
    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_sha binary, text binary")


def _unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in column.to_pylist()]


def _tie(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big") - (1 << 63)


def plain_marks(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_sha, words_sha, n_words) of the rows that hold a window."""
    def run(batches):
        for b in batches:
            words = [words_of(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary()),
                                              pa.array(map(len, words), pa.int64())], ["doc_id", "text_sha", "words_sha", "n_words"])
    return _keyed(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, text_sha binary, words_sha binary, n_words long").where(F.col("n_words") >= width)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("text_sha"), text.alias("text"))


# ------------------------------------------------------------------ anchors that occur more than once

def _gathered(batches, columns: list[tuple[str, str]], chunk: int) -> Iterator[tuple[list[int], dict[str, np.ndarray], dict[str, list]]]:
    """Rows whose first column is packed, about ``chunk`` values together: their sizes, packed columns, other columns."""
    def done():
        return sizes, {c: np.frombuffer(b"".join(rows[c]), k) for c, k in columns}, {c: v for c, v in rows.items() if c not in dict(columns)}
    sizes, rows, total, wide = [], None, 0, np.dtype(columns[0][1]).itemsize
    for b in batches:
        lists = {c: b.column(c).to_pylist() for c in b.schema.names}
        for i in range(b.num_rows):
            rows = rows if sizes else {c: [] for c in lists}
            for c in lists:
                rows[c].append(lists[c][i])
            sizes.append(len(lists[columns[0][0]][i]) // wide)
            total += sizes[-1]
            if total >= chunk:
                yield done()
                sizes, total = [], 0
    if sizes:
        yield done()


def shared_anchors(reps: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(rep, gram) of anchors that occur at two places at least.

    A task keeps those it holds twice itself, and sends each hash once, without its owners if that is settled.  ``rep`` is a hash
    of the text's words: should two texts share one, each also gets the other's anchors, which only makes more candidates.
    """
    many = reps.agg(F.sum(F.length("anchors") / 8)).first()[0] or 0
    bins = max(1, math.ceil(2 * many / sizes.group))

    def own(batches):
        for counts, packed, other in _gathered(batches, [("anchors", "<u8")], sizes.chunk):
            hashes, owner = packed["anchors"], np.repeat(np.array(other["rep"], np.int64), counts)
            order = np.argsort(hashes, kind="stable")
            yield hashes[order], owner[order], np.diff(np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0, [True]))) if len(order) else [0])

    def known(batches):
        for hashes, owner, n in own(batches):
            twice = np.repeat(n, n) > 1
            yield pa.RecordBatch.from_arrays([pa.array(owner[twice]), pa.array(hashes[twice].view(np.int64))], ["rep", "gram"])

    def sent(batches):
        for hashes, owner, n in own(batches):
            first = np.cumsum(n) - n
            h, o = hashes[first][n == 1], owner[first][n == 1]
            at, settled = _bin(h, bins), hashes[first][n > 1]
            order = np.lexsort((o, at))  # an owner's hashes of a bin side by side, so that owners are packed once each
            at, h, o = at[order], h[order], o[order]
            of_settled = _bin(settled, bins)
            for k in np.unique(np.concatenate((at, of_settled))).tolist():
                a, z = np.searchsorted(at, (k, k + 1))
                owners, many = np.unique(o[a:z], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[_binary([x]) for x in (
                    h[a:z], owners, many.astype("<i4"), settled[of_settled == k])]], ["bin", "hashes", "owners", "counts", "settled"])

    def met(table: pa.Table) -> pa.Table:
        hashes, owners, counts, settled = (_joined(table.column(c), k) for c, k in (("hashes", "<u8"), ("owners", "<i8"), ("counts", "<i4"), ("settled", "<u8")))
        _, where, n = np.unique(np.concatenate((hashes, settled)), return_inverse=True, return_counts=True)
        found = n[where[:len(hashes)]] > 1
        return pa.table({"rep": np.repeat(owners, counts)[found], "gram": hashes[found].view(np.int64)})
    some = reps.select("rep", "anchors")
    return some.mapInArrow(known, "rep long, gram long").unionByName(
        some.mapInArrow(sent, "bin int, hashes binary, owners binary, counts binary, settled binary").groupBy("bin").applyInArrow(met, "rep long, gram long"))


def _bin(hashes: np.ndarray, bins: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(bins)).astype(np.int64)


def segments(texts: DataFrame, width: int, sizes: Sizes = Sizes()) -> DataFrame:
    """(codes, starts, sizes, rep, doc_id): the stretches of a text whose windows may repeat, as word codes.

    ``texts`` is (rep, doc_id, compressed text, grams).  An anchor repeated for one text is repeated for all, so a piece needs no list per text.
    """
    def run(batches):
        memo = Memo(_code, REMEMBERED)
        for b in batches:
            for lo, words, piece in pieces(_unpacked(b.column("text")), width, memo, sizes.chunk):
                grams = b.column("grams").slice(lo, len(words)).flatten().to_numpy().view(np.uint64)
                found = piece.windows[np.isin(piece.grams[piece.places[piece.windows]], grams)]
                n = len(piece.codes)
                cover = np.cumsum(np.bincount(found, minlength=n + 1) - np.bincount(found + width, minlength=n + 1)[:n + 1])[:n] > 0
                edge = np.concatenate(([True], np.diff(piece.owner) != 0)) if n else np.empty(0, bool)
                begin = np.flatnonzero(cover & (edge | ~np.concatenate(([False], cover[:-1]))))
                end = np.flatnonzero(cover & np.concatenate((edge[1:] | ~cover[1:], [True]))) + 1 if n else begin
                of = piece.owner[begin] if n else begin
                cuts = np.searchsorted(of, np.arange(len(words) + 1))
                first = piece.ends - piece.counts
                stretches = [(begin[x:y], end[x:y]) for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [_binary(np.concatenate([piece.codes[x:y] for x, y in zip(s, e)]) if len(s) else s for s, e in stretches),
                     _binary((s - f).astype("<i4") for (s, _), f in zip(stretches, first)), _binary((e - s).astype("<i4") for s, e in stretches),
                     b.column("rep").slice(lo, len(words)), b.column("doc_id").slice(lo, len(words))], ["codes", "starts", "sizes", "rep", "doc_id"])
    return texts.select("rep", "doc_id", "text", "grams").mapInArrow(run, "codes binary, starts binary, sizes binary, rep long, doc_id long")


# ------------------------------------------------------------------ suffixes, prefixes, subtrees

class Suffixes:
    """Suffixes cut at a window's depth: a letter of eight bits per word, a hash of the whole window, and where they start."""

    KINDS = {"letters": "u1", "tails": "<u8", "ids": "<i8", "reps": "<i8", "starts": "<i4"}

    def __init__(self, width: int, **columns: np.ndarray):
        self.width = width
        self.letters = columns.pop("letters").reshape(-1, width)
        self.__dict__.update(columns)

    def __getitem__(self, rows) -> Suffixes:
        return Suffixes(self.width, **{c: getattr(self, c)[rows] for c in self.KINDS})

    def __len__(self) -> int:
        return len(self.tails)

    def prefixes(self, depth: int) -> np.ndarray:
        return np.ascontiguousarray(self.letters[:, :depth]).view(f"S{depth}").ravel() if len(self) else np.empty(0, f"S{depth}")

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, c)).astype(k, copy=False).tobytes() for c, k in self.KINDS.items()]

    def nodes(self) -> tuple[Suffixes, np.ndarray]:
        """The suffixes in tree order, each node's first occurrence first, and the node of at least a window's depth each one is under.

        Neighbours share as many letters as the depth of the node that joins them; a window's hash tells apart what only the letters join.
        """
        wide = -self.width % 8
        keys = np.pad(self.letters, ((0, 0), (0, wide))).view(">u8") if len(self) else np.empty((0, 1))
        order = np.lexsort((self.starts, self.reps, self.ids, self.tails, *keys.T[::-1]))
        tree = self[order]
        common = np.logical_and.accumulate(tree.letters[1:] == tree.letters[:-1], axis=1).sum(1)
        common[tree.tails[1:] != tree.tails[:-1]] = 0
        return tree, np.cumsum(np.concatenate(([0], common < self.width))) if len(self) else np.empty(0, np.int64)

    def split(self) -> tuple[Suffixes, Suffixes]:
        """(first suffix of every deep node, suffixes that start later than their node's first one)."""
        tree, node = self.nodes()
        first = np.flatnonzero(np.concatenate(([True], np.diff(node) != 0))) if len(self) else node
        at = first[node] if len(self) else node
        later = (tree.ids != tree.ids[at]) | (tree.reps != tree.reps[at]) | (tree.starts != tree.starts[at])  # a row that is repeated is not later than itself
        return tree[first], tree[later]


def _chunks(batches, width: int, chunk: int) -> Iterator[tuple[Suffixes, Suffixes]]:
    """First and later suffixes of each chunk of ``segments``."""
    for counts, packed, other in _gathered(batches, [("codes", "<u8"), ("starts", "<i4"), ("sizes", "<i4")], chunk):
        codes, size = packed["codes"], packed["sizes"].astype(np.int64)
        if not len(codes):
            continue
        segment = np.repeat(np.arange(len(size)), size)
        row = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(packed["starts"], size)
        whole = np.flatnonzero(segment[:max(0, len(codes) - width + 1)] == segment[width - 1:])
        letter = ((codes >> np.uint64(7)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        letters = np.lib.stride_tricks.sliding_window_view(letter, width)[whole]
        ids = np.array([LAST if i is None else i for i in other["doc_id"]], np.int64)
        yield Suffixes(width, letters=letters, tails=run_hashes(codes, width)[whole], ids=ids[row[whole]],
                       reps=np.array(other["rep"], np.int64)[row[whole]], starts=inside[whole].astype(np.int32)).split()


def long_prefixes(parts: DataFrame, width: int, sizes: Sizes = Sizes()) -> tuple[dict[int, dict[bytes, int]], int]:
    """Prefixes that more than ``group`` suffixes share, by length with their counts, and the number of suffixes.

    A pass counts two lengths below the prefixes already known to be too frequent; per length at most suffixes / ``group`` reach the driver.
    """
    found: dict[int, dict[bytes, int]] = {}
    total, before = 0, None
    for depths in DEPTHS:
        lengths = sorted({min(d or width, width) for d in depths} - set(found))
        if not lengths or (before is not None and not found[before]):
            break
        above = np.array(sorted(found[before]), f"S{before}") if before else None

        def run(batches, lengths=lengths, before=before, above=above):
            for firsts, _ in _chunks(batches, width, sizes.chunk):
                rows = firsts if above is None else firsts[np.isin(firsts.prefixes(before), above)]
                for depth in lengths:
                    names, n = np.unique(rows.prefixes(depth), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), depth, np.int32)), pa.array(names.tolist(), pa.binary()), pa.array(n)],
                                                     ["depth", "prefix", "n"])
        counts = parts.mapInArrow(run, "depth int, prefix binary, n long").groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
        if before is None:
            counts = cut_lineage(counts)
            total = counts.where(F.col("depth") == lengths[0]).agg(F.sum("n")).first()[0] or 0
        for depth in lengths:
            found[depth] = {}
        for r in counts.where(F.col("n") > sizes.group).collect():
            found[r["depth"]][bytes(r["prefix"])] = r["n"]
        before = lengths[-1]
    return found, total


def _group(suffixes: Suffixes, frequent: dict[int, dict[bytes, int]], bins: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, salt) of each suffix: by the shortest prefix that is not too frequent; salt 0, but for a window that is so itself."""
    group, salt = np.full(len(suffixes), -1, np.int64), np.zeros(len(suffixes), np.int64)
    open_, depth = np.arange(len(suffixes)), 1
    while len(open_):
        names, where = np.unique(suffixes[open_].prefixes(depth), return_inverse=True)
        often = np.array([frequent.get(depth, {}).get(bytes(n), 0) for n in names.tolist()], np.int64)[where]
        if depth == suffixes.width:
            salts = -(-often // most)
            spread = (suffixes.reps[open_].astype(np.uint64) * ODD >> np.uint64(33)).astype(np.int64)
            salt[open_] = np.where(salts > 0, 1 + spread % np.maximum(1, salts), 0)
            often[:] = 0
        group[open_] = np.array([zlib.crc32(n) % bins for n in names.tolist()], np.int64)[where]
        open_ = open_[often > 0]
        depth = min((d for d in frequent if d > depth), default=suffixes.width)
    return group, salt


def covered(parts: DataFrame, width: int, sizes: Sizes = Sizes()) -> DataFrame:
    """(ids, reps, starts), packed: windows that also start earlier."""
    frequent, many = long_prefixes(parts, width, sizes)
    bins = max(1, math.ceil(2 * many / sizes.group))
    shared = parts.sparkSession.sparkContext.broadcast(frequent)
    names, kind = list(Suffixes.KINDS), "bin int, salt int, letters binary, tails binary, ids binary, reps binary, starts binary"

    def known(batches):
        for _, later in _chunks(batches, width, sizes.chunk):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in later.packed()[2:]], names[2:])

    def sent(batches):
        for firsts, _ in _chunks(batches, width, sizes.chunk):
            group, salt = _group(firsts, shared.value, bins, sizes.group)
            order = np.lexsort((firsts.starts, firsts.reps, salt, group))
            both = np.stack((group, salt), 1)[order]
            cuts = np.flatnonzero(np.concatenate(([True], (both[1:] != both[:-1]).any(1)))) if len(order) else order
            rows = [firsts[order[a:z]].packed() for a, z in zip(cuts, np.append(cuts[1:], len(order)))]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(both[cuts, 0].astype(np.int32)), pa.array(both[cuts, 1].astype(np.int32)),
                                              *[pa.array(c, pa.binary()) for c in columns]], ["bin", "salt", *names])

    def tree(table: pa.Table) -> pa.Table:
        firsts, later = Suffixes(width, **{c: _joined(table.column(c), k) for c, k in Suffixes.KINDS.items()}).split()
        rows = [[None, None, *later.packed()[2:]]]
        if table.column("salt")[0].as_py():  # what is first here meets the firsts of the window's other salts
            rows.append(firsts.packed())
        columns = list(zip(*rows))
        return pa.table({"bin": pa.array([table.column("bin")[0].as_py()] * len(rows), pa.int32()), "salt": pa.array([0] * len(rows), pa.int32()),
                         **{c: pa.array(v, pa.binary()) for c, v in zip(names, columns)}})
    grown = parts.mapInArrow(sent, kind)
    out = grown.groupBy("bin", "salt").applyInArrow(tree, kind)
    if frequent.get(width):
        out = cut_lineage(out)
        again = out.where("letters is not null").groupBy("bin").applyInArrow(tree, kind)
        out = out.where("letters is null").unionByName(again)
    return parts.mapInArrow(known, "ids binary, reps binary, starts binary").unionByName(out.select(*names[2:]))


def merged(windows: DataFrame, width: int, sizes: Sizes = Sizes()) -> DataFrame:
    """(id, rep, spans): covered windows of each text merged into spans of words."""
    many = windows.agg(F.sum(F.length("starts") / 4)).first()[0] or 0
    bins = max(1, math.ceil(2 * many / sizes.group))

    def dealt(batches):
        for _, packed, _ in _gathered(batches, [("starts", "<i4"), ("reps", "<i8"), ("ids", "<i8")], sizes.chunk):
            ids, reps, starts = packed["ids"], packed["reps"], packed["starts"]
            at = ((reps.astype(np.uint64) * ODD) >> np.uint64(33)).astype(np.int64) % bins
            order = np.lexsort((starts, reps, ids, at))
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) != 0))) if len(order) else order
            ends = np.append(cuts[1:], len(order))
            yield pa.RecordBatch.from_arrays([pa.array(at[order][cuts].astype(np.int32)), *[
                _binary(x[order[a:z]] for a, z in zip(cuts, ends)) for x in (ids, reps, starts)]], ["bin", "ids", "reps", "starts"])

    def spans(table: pa.Table) -> pa.Table:
        ids, reps, starts = (_joined(table.column(c), k) for c, k in (("ids", "<i8"), ("reps", "<i8"), ("starts", "<i4")))
        order = np.lexsort((starts, reps, ids))
        ids, reps, starts = ids[order], reps[order], starts[order].astype(np.int64)
        new = np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(reps) != 0)))
        begin = np.flatnonzero(new | np.concatenate(([True], np.diff(starts) > width)))
        end = starts[np.append(begin[1:], len(starts)) - 1] + width
        own = np.flatnonzero(new[begin])
        offsets = pa.array(np.append(own, len(begin)).astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(starts[begin]), pa.array(end)], ["start", "end"])
        return pa.table({"id": pa.array(ids[begin][own]), "rep": pa.array(reps[begin][own]), "spans": pa.ListArray.from_arrays(offsets, pairs)})
    return (windows.select("starts", "reps", "ids").mapInArrow(dealt, "bin int, ids binary, reps binary, starts binary").groupBy("bin")
            .applyInArrow(spans, "id long, rep long, spans array<struct<start:long,end:long>>"))


# ------------------------------------------------------------------ documents

def deduplicated(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
                 sizes: Sizes = Sizes()) -> DataFrame:
    """(doc_id, n_words, spans, kept): the removed spans of words (end exclusive) of every row, and its other words joined by a space.

    Earlier is a smaller id, or an earlier start in the same document; a null id is behind all others.  Texts of one id stand in
    the order of a hash of their words; a row repeated with its id is one document and loses nothing to its copy.  A null text is
    empty; texts shorter than a window stay as they are.  Ids are whole numbers.
    """
    spans = "array<struct<start:long,end:long>>"
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha"))
    reps = marks(docs, width, id_col, text_col, sizes).where(F.col("n_words") >= width).groupBy("words_sha").agg(
        least.alias("r"), F.first("tie").alias("rep"), F.first("anchors").alias("anchors"), F.count("*").alias("rows"))
    reps = cut_lineage(reps.select("rep", "words_sha", "r.doc_id", "r.text_sha", "anchors", "rows"))
    grams = shared_anchors(reps, sizes).groupBy("rep").agg(F.collect_set("gram").alias("grams"))
    suspects = grams.join(reps.select("rep", F.col("doc_id").alias("id__"), F.col("text_sha").alias("sha__")), "rep")
    texts = _carried(docs, id_col, text_col)
    same = texts["text_sha"].eqNullSafe(suspects["sha__"]) & texts["doc_id"].eqNullSafe(suspects["id__"])
    parts = cut_lineage(segments(texts.join(suspects, same), width, sizes))
    found = cut_lineage(merged(cut_lineage(covered(parts, width, sizes)), width, sizes))
    # one row per different words: where they stand first, and what is covered there
    key = [F.coalesce("doc_id", F.lit(LAST)).alias("id"), "rep"]
    firsts = cut_lineage(reps.select(*key, "words_sha", F.col("doc_id").alias("first"), "rows").join(found, ["id", "rep"], "left")
                         .select("words_sha", F.struct("first", "spans").alias("at"), F.col("rows").alias("weight")))
    rows = lookup(plain_marks(docs, width, id_col, text_col).distinct(), firsts, "words_sha", "at", "weight", "text_sha")
    gone = (F.when(~F.col("doc_id").eqNullSafe(F.col("at.first")), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))))
            .otherwise(F.col("at.spans")).cast(spans))
    plan = rows.select(F.col("doc_id").alias("id__"), F.col("text_sha").alias("sha__"), gone.alias("spans")).where("spans is not null")
    same = texts["text_sha"].eqNullSafe(plan["sha__"]) & texts["doc_id"].eqNullSafe(plan["id__"])
    joined = texts.join(plan, same, "left").select("doc_id", "text", F.coalesce("spans", F.array().cast(spans)).alias("spans"))

    def run(batches):
        for b in batches:
            counts, kept = [], []
            for text, cuts in zip(_unpacked(b.column(1)), b.column(2).to_pylist()):
                words = words_of(text)
                counts.append(len(words))
                for c in reversed(cuts):
                    del words[c["start"]:c["end"]]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), b.column(2), pa.array(kept, pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_words", "spans", "kept"])
    return joined.mapInArrow(run, f"doc_id long, n_words long, spans {spans}, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return deduplicated(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """The same in SQL: every window with its place, those that are not the first of their words, the words they cover."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
hashed AS (SELECT n, doc_id, list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: md5(array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS h
    FROM d WHERE len(w) >= {WIDTH}),
windows AS (SELECT n, doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS i FROM hashed),
placed AS (SELECT n, i, first_value((doc_id, i)) OVER (PARTITION BY h ORDER BY doc_id, i) < (doc_id, i) AS again FROM windows),
flat AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
marked AS (SELECT n, i, word, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY n ORDER BY i) < {WIDTH}, false) AS gone
    FROM flat LEFT JOIN placed USING (n, i)),
sums AS (SELECT n, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (n)"""
