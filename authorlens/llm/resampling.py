"""Target-distribution importance resampling over hashed word runs.

A feature is a run of words; its bucket is the CRC-32 of its bytes.  How much more frequent a
bucket is in the target than in the corpus is its gain; a document weighs the mean gain of its
features, and documents are drawn without replacement by the largest of weight plus Gumbel noise.

CRC-32 is affine over XOR: the checksum of a message is the XOR of what each byte contributes at
its distance from the end, and of a constant for the length.  Both are tables made once
(``TABLE``, ``LENGTHS``), so a batch of texts is one look-up per byte and one
``bitwise_xor.reduceat`` over the features' spans.  Features longer than ``REACH`` bytes fold block
by block: a checksum is carried over ``REACH`` bytes by four look-ups, then takes the next block in.

Texts are read twice, row by row.  What the driver sees is a count per bucket; ranks come from
sorted partitions and their sizes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from authorlens.session import cut_lineage

BUCKETS = 10_000
SHORTEST, LONGEST = 1, 1  # words of a feature
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
REACH = 64  # bytes from the end that the tables cover
PIECE = 1 << 20  # bytes looked at together, or one text
# Fixed value: what is a word, over bytes; all bytes of other scripts belong to words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contributions by (distance from the end, byte), constants by length, and a checksum's four bytes carried over REACH bytes."""
    lengths = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)
    table = np.array([[zlib.crc32(bytes([b]) + bytes(d)) for b in range(256)] for d in range(REACH)], np.uint32) ^ lengths[1:, None]
    carry = np.array([[zlib.crc32(bytes(REACH), b << 8 * k) for b in range(256)] for k in range(4)], np.uint32) ^ lengths[REACH]
    return table, lengths, carry


TABLE, LENGTHS, CARRY = _tables()


def _block(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of at most REACH bytes."""
    out = LENGTHS[sizes]
    some = np.flatnonzero(sizes)
    if len(some):
        n = sizes[some]
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        out[some] ^= np.bitwise_xor.reduceat(TABLE[np.repeat(n, n) - 1 - step, data[np.repeat(starts[some], n) + step]], first)
    return out


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for every span; spans may overlap, be empty or be long."""
    starts = np.asarray(starts, np.int64)
    sizes = np.asarray(ends, np.int64) - starts
    head = np.where(sizes > 0, (sizes - 1) % REACH + 1, 0)  # the first block is the short one
    out = np.empty(len(starts), np.uint32)
    cuts = np.searchsorted(np.cumsum(head), np.arange(0, head.sum() + 1, PIECE)).tolist() + [len(starts)]
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = _block(data, starts[lo:hi], head[lo:hi])
    done, long = head, np.flatnonzero(sizes > REACH)
    while len(long):
        r = out[long]
        out[long] = (CARRY[0][r & 255] ^ CARRY[1][r >> 8 & 255] ^ CARRY[2][r >> 16 & 255] ^ CARRY[3][r >> 24]
                     ^ _block(data, starts[long] + done[long], np.full(len(long), REACH)))
        done[long] += REACH
        long = long[done[long] < sizes[long]]
    return out


def features(texts: list[bytes | None], buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> Iterator[
        tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every piece of the texts: words of each text, and of each feature its text's number in the piece and its bucket."""
    lo = size = 0
    for i, t in enumerate([*texts, None]):
        if i == len(texts) or (size and size + len(t or b"") > PIECE):
            words = [WORD.findall((x or b"").lower()) for x in texts[lo:i]]  # bytes: only A-Z change
            flat = [w for ws in words for w in ws]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            owner = np.repeat(np.arange(len(words)), counts)
            ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
            starts = np.concatenate(([0], ends + 1))[:len(flat)]
            data = np.frombuffer(b" ".join(flat), np.uint8)
            of, found = [], []
            for n in range(shortest, longest + 1):
                whole = np.flatnonzero(owner[:max(0, len(flat) - n + 1)] == owner[n - 1:])
                of.append(owner[whole])
                found.append(crc32_spans(data, starts[whole], ends[whole + n - 1]) % np.uint32(buckets))
            yield counts, np.concatenate(of), np.concatenate(found)
            lo, size = i, 0
        size += len(t or b"")


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> np.ndarray:
    """Features per bucket over all texts; every task sums its own, so Spark adds at most ``buckets`` rows a task."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, found in features(b.column(0).to_pylist(), buckets, shortest, longest):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])
    rows = texts.select(F.col(text_col).cast("binary")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)
    for r in rows:  # a row per bucket
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source, target)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
            longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a text's features, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for b in batches:
            parts = [(np.empty(0, np.int64),) * 3]
            for words, of, found in features(b.column(1).to_pylist(), len(shared.value), shortest, longest):
                n = np.bincount(of, minlength=len(words))
                total = np.zeros(len(words), np.int64)
                np.add.at(total, of, shared.value[found])
                parts.append((words, n, total // np.maximum(n, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)]],
                                             ["doc_id", "n_words", "n_features", "weight"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """``weights`` with ``score``: the weight plus a Gumbel draw made from the seed and the id; a null id draws like an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3, ... in the order given, without sorting in one task; wholly equal rows may swap.

    Rows go to ranges of the order; a number of their own splits what ties.  Each range is
    numbered by itself, on top of the sizes of the ranges before it (a row per partition).
    """
    spread = cut_lineage(rows.withColumn("tie__", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, "tie__")
                         .withColumn("part__", F.spark_partition_id()))
    sizes = spread.groupBy("part__").agg(F.count("*").alias("n__"))
    firsts = sizes.select("part__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first__"))
    inner = spread.withColumn("at__", F.row_number().over(Window.partitionBy("part__").orderBy(*order, "tie__")))
    return inner.join(F.broadcast(firsts), "part__").withColumn("rank", F.col("first__") + F.col("at__")).drop("part__", "at__", "first__", "tie__")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
              shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn.

    A null or wordless text has no feature and weight 0 and is never drawn; repeated rows are
    documents of their own, of equal score; of equal scores the smaller id is first, a null id
    last.  An empty target or corpus only smooths; an empty table gives no row.
    """
    gain = gains(bucket_counts(docs, "text", buckets, shortest, longest), bucket_counts(target, "text", buckets, shortest, longest))
    rows = cut_lineage(scored(weighed(docs, gain, shortest=shortest, longest=longest), seed))
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    order = ranked(rows.where(able).select(*columns), [F.desc("score"), F.asc_nulls_last("doc_id")])
    rest = rows.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    return order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")).select(*columns, "rank").unionByName(rest)


def oracle() -> str:
    """The same in SQL; the checksum is folded over the hexadecimal digits of each different word."""
    words = (r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    bits = "n::BIGINT"
    for _ in range(8):
        bits = f"(SELECT {step} FROM (SELECT {bits} AS c))"
    ln = "floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM counts) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM counts) + 10000.0::DOUBLE))))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {words.format('text')} AS w FROM documents),
b AS (SELECT unnest({words.format('text')}) AS word FROM benchmark),
dw AS (SELECT n, unnest(w) AS word FROM d),
tab AS MATERIALIZED (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, {bits} AS v FROM range(256) r(n))),
named AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM b)),
crc AS MATERIALIZED (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2),
    lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, v: xor(c // 256, tab[xor(c % 256, v) + 1])), 4294967295) % 10000 AS bucket FROM named, tab),
counts AS MATERIALIZED (SELECT k.bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT range AS bucket FROM range(10000)) k
    LEFT JOIN (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY 1) a ON a.bucket = k.bucket
    LEFT JOIN (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY 1) c ON c.bucket = k.bucket),
gain AS MATERIALIZED (SELECT bucket, ({ln})::BIGINT AS g FROM counts),
weights AS (SELECT n, floor(sum(g)::HUGEINT / count(*))::BIGINT AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY n),
scores AS (SELECT n, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM d LEFT JOIN weights USING (n)),
able AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS many FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, (CASE WHEN r <= many * {PERCENT} // 100 THEN r END)::BIGINT AS rank FROM scores LEFT JOIN able USING (n)"""
