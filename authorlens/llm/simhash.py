"""SimHash near-duplicates: Golay codeword keys, pigeonholed over fingerprint segments.

A fingerprint has three segments of 23, 23 and 18 bits.  With at most two differing bits one
segment is untouched and the next one differs in at most two bits, so a pair shares the
untouched segment and, of the next one, the codeword that a vector half-way between both
decodes to: every vector is listed under the codewords of itself and its one-bit neighbours
(one to six of them, as the (23,12) Golay code is perfect with radius three).  Candidates are
verified by ``bit_count``.

Buckets of more than ``HOT`` fingerprints are not paired.  Their fingerprints are listed
under every 64-bit value at distance at most one instead.  All members of such a ball are
within two bits of each other, and two fingerprints within two bits always share a ball, so a
star inside each ball (at most 65 members) gives the same components without any pair.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from authorlens.operators.graph import components
from authorlens.session import cut_lineage

SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # (first bit, width)
HOT = 64
# Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


# ------------------------------------------------------------------ fingerprints

def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; one shingle for a shorter non-empty text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        pieces = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pieces = [joined[a:b] for a, b in zip(starts[:1 - width or None].tolist(), ends[width - 1:].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint: bit i is 1 if set in more than half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at:at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, text_sha): one row per document; a null or blank text has fingerprint 0."""
    def run(batches):
        for b in batches:
            values = [majority_bits(shingle_hashes(t, width)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(values, np.uint64).view(np.int64)), b.column(2)], ["doc_id", "fp", "text_sha"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_sha(text_col)).mapInArrow(
        run, f"doc_id {kind}, fp long, text_sha binary")


def text_sha(text_col: str = "text") -> Column:
    """What tells rows of one id apart; null where the text is."""
    return F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)).alias("text_sha")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ------------------------------------------------------------------ Golay keys

def _remainders(values: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator: the syndrome."""
    r = values.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - 11), 0)
    return r


def _error_table() -> np.ndarray:
    """Error pattern of weight at most three for each of the 2,048 syndromes."""
    singles = [1 << i for i in range(23)]
    errors = [0, *singles]
    errors += [a | b for i, a in enumerate(singles) for b in singles[:i]]
    errors += [a | b | c for i, a in enumerate(singles) for j, b in enumerate(singles[:i]) for c in singles[:j]]
    table = np.zeros(2048, np.int64)
    table[_remainders(np.array(errors))] = errors
    return table


def codewords(values: np.ndarray, width: int, errors: np.ndarray | None = None) -> np.ndarray:
    """Row per value: codeword numbers of the value and of its one-bit neighbours, repeats replaced by -1."""
    errors = _error_table() if errors is None else errors
    flips = np.array([0] + [1 << i for i in range(width)])
    near = values.astype(np.int64)[:, None] ^ flips
    found = np.sort((near ^ errors[_remainders(near)]) >> 11, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def golay_keys(prints: DataFrame) -> DataFrame:
    """(key, fp) for a column ``fp`` of distinct fingerprints; at most 18 keys each."""
    def run(batches):
        errors = _error_table()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [(fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << w) - 1) for at, w in SEGMENTS]
            for z in range(3):
                y = (z + 1) % 3
                words = codewords(parts[y], SEGMENTS[y][1], errors)
                row, col = np.nonzero(words >= 0)
                key = (np.int64(z) << 35) | (parts[z][row] << 12) | words[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])
    return prints.select("fp").mapInArrow(run, "key long, fp long")


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) edges among distinct fingerprints with the components of "at most two differing bits"."""
    keys = golay_keys(prints)
    sizes = keys.groupBy("key").count().where("count > 1")
    shared = cut_lineage(keys.join(sizes, "key"))
    # a bucket of at most `hot` members is one bounded list; pairs are tested inside it
    lists = shared.where(F.col("count") <= hot).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = (lists.select("fps", F.posexplode("fps").alias("i", "a"))
             .select("a", F.explode(F.expr("filter(slice(fps, i + 2, size(fps)), b -> bit_count(a ^ b) <= 2)")).alias("b")))
    crowd = shared.where(F.col("count") > hot).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    balls = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("ball"))
    lows = balls.groupBy("ball").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = balls.join(lows, "ball").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def groups(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Component of each document.

    ``prints`` has doc_id, fp and any other columns; returns them with ``root``, which names the component, and
    ``component_id``, the smallest doc_id reachable.  A null doc_id is grouped too and never is a component's name
    unless all its documents are without id.  Repeated rows stay rows.  An empty table gives none.
    """
    prints = cut_lineage(prints)
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(cut_lineage(links(nodes, hot)))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(names, "root").select("fp", "root", "component_id"), "fp").select(*prints.columns, "root", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row of smallest doc_id stays.

    A null doc_id comes last, rows of one id in the order of a hash of their texts, and of wholly repeated rows one stays.
    All null, empty and blank texts have fingerprint 0 and are one component.
    """
    found = groups(fingerprints(docs, width), hot)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha")).alias("r")
    stays = found.groupBy("root").agg(first).select(F.col("r.doc_id").alias("id__"), F.col("r.text_sha").alias("sha__"))
    times = found.groupBy("doc_id", "text_sha").agg(F.count("*").alias("times__"))
    stays = cut_lineage(stays.join(times, stays["id__"].eqNullSafe(times["doc_id"]) & stays["sha__"].eqNullSafe(times["text_sha"]))
                        .select("id__", "sha__", "times__"))
    marked = docs.withColumn("sha_of__", text_sha())
    kept = marked.join(stays, marked["doc_id"].eqNullSafe(stays["id__"]) & marked["sha_of__"].eqNullSafe(stays["sha__"]))
    once, often = kept.where("times__ = 1"), kept.where("times__ > 1").dropDuplicates(["doc_id", "sha_of__"])
    return once.unionByName(often).select(*docs.columns)


def near_duplicates(docs: DataFrame, width: int = 3, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    found = groups(fingerprints(docs, width).drop("text_sha"), hot)
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
