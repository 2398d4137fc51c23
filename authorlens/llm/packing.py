"""Packing: shortest pack first over the histogram of lengths.

A document's ids, and the closing id, are cut into full sequences and a rest.  The histogram of
rests (at most ``size`` numbers, whatever the corpus) is packed: lengths are placed longest
first, each into the open pack with the most room that it fits, many equal packs at a time.
That gives patterns with counts; in each slot of a pattern the pieces of that length with a
certain range of ranks find their sequence and offset.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from authorlens.llm.ranks import numbered
from authorlens.llm.tokens import byte_characters, vocabulary
from authorlens.session import cut_lineage

SIZE = 2048
CLOSING = 1
# Fixed value: how this tokenizer cuts texts.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HUGE = 500_000


# ------------------------------------------------------------------ ids

class Encoder:
    """Little-endian ids of texts.

    A byte-pair engine given the same vocabulary, whose ids are the ranks of the merges, is
    several times faster than the library that defines the ids and gives the same; texts with a
    special string, and huge ones, go to that library.
    """

    def __init__(self, definition: str):
        self.tok = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        of = byte_characters()
        ranks = {bytes(of[c] for c in word): i for word, i in json.loads(definition)["model"]["vocab"].items() if word not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) > HUGE or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@lru_cache(maxsize=1)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)


def pieces(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every document cut into full sequences and a rest."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    closing = np.array([CLOSING], "<u4").tobytes()

    def run(batches):
        ids_of = encoder(shared.value).ids
        for b in batches:
            rows = []
            for at, text in enumerate(b.column(1).to_pylist()):
                ids = ids_of(text) + closing
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start:4 * (start + size)]
                    rows.append((at, start, len(part) // 4, zlib.crc32(part), total, part if keep_ids else None))
            at, *values = zip(*rows) if rows else [()] * 6
            columns = [pa.array(v, pa.int64()) for v in values[:4]] + [pa.array(values[4], pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


# ------------------------------------------------------------------ patterns

def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many packs) pairs that hold every piece of the histogram once.

    Packs of equal room are one entry with a count, so the work follows the number of distinct
    lengths and patterns, not of pieces.  Ties go to the pattern opened first.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # room: [pattern, count]
    rooms: list[int] = []  # heap of rooms, largest first
    for length in sorted(histogram, reverse=True):
        left, fitting = histogram[length], []
        while left and rooms and -rooms[0] >= length:
            room = -rooms[0]
            if not open_packs[room]:
                heapq.heappop(rooms)
                continue
            entry = open_packs[room][-1]
            n = min(left, entry[1])
            left -= n
            entry[1] -= n
            if not entry[1]:
                open_packs[room].pop()
            fitting.append((room - length, [(*entry[0], length), n]))
        if left:
            # as many to a new pack as fit: a pack of k equal pieces, and one with the remainder
            k = size // length
            for each, n in ((k, left // k), (left % k, 1)):
                if each and n:
                    fitting.append((size - each * length, [(length,) * each, n]))
        for room, entry in fitting:
            open_packs[room].append(entry)
            heapq.heappush(rooms, -room)
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for entries in open_packs.values():
        for pattern, n in entries:
            merged[pattern] += n
    return sorted(merged.items())


def slots(packs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), by first rank."""
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list] = defaultdict(list)
    sequence = 0
    for pattern, n in packs:
        offset = 0
        for length in pattern:
            rows[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` with sequence_id and offset; sequence ids are gapless from 0, offsets leave no gap in a sequence."""
    ranked = cut_lineage(numbered(parts, "length", ["doc_id", "start", "ids_crc32"], "rank"))
    histogram = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}  # at most `size` rows
    shared = ranked.sparkSession.sparkContext.broadcast(slots(patterns(histogram, size)))

    def run(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                table, mine = shared.value[n], length == n
                row = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                sequence[mine], offset[mine] = row[:, 1] + rank[mine] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(offset)], [*b.schema.names, "sequence_id", "offset"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long").drop("rank")


def packed(docs: DataFrame, path: str, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """A row per piece of every document; a null or empty text is the closing id alone; an empty table gives no rows.

    Repeated rows are packed as often as they occur.
    """
    return pack(pieces(docs.select("doc_id", "text"), path, size, keep_ids=keep_ids), size)
