"""The checksum against the library, weights and draws against a plain version, odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from authorlens.llm import resampling
from tests.llm.odd import docs, none

rng = random.Random(13)


def test_checksum_of_spans():
    data = rng.randbytes(5_000)
    spans = [(0, 0), (5, 5), (0, 1), (0, 64), (0, 65), (3, 131), (0, 5_000), (4_999, 5_000)]
    spans += [(a, a + rng.choice((0, 1, 3, 9, 63, 64, 65, 128, 129, 700))) for a in rng.choices(range(4_000), k=400)]
    got = resampling.crc32_spans(np.frombuffer(data, np.uint8), *zip(*spans))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


def test_many_spans_in_pieces(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 50)
    data = rng.randbytes(3_000)
    spans = [(a, a + rng.randrange(200)) for a in rng.choices(range(2_800), k=300)]
    assert resampling.crc32_spans(np.frombuffer(data, np.uint8), *zip(*spans)).tolist() == [zlib.crc32(data[a:b]) for a, b in spans]
    assert resampling.crc32_spans(np.frombuffer(data, np.uint8), [], []).tolist() == []


def plain(rows, target, shortest, longest, percent, least, seed, buckets):
    """The contract word by word, with the library's checksum."""
    def words(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def found(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(b for _, x in rows for b in found(x)), Counter(b for x in target for b in found(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, x in rows:
        bs = found(x)
        weight = sum(map(gain, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able, 1) if k <= percent * len(able) // 100}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_draws(spark, longest):
    vocabulary = ["".join(rng.choices("abcXYZé中9", k=rng.randint(1, 6))) for _ in range(120)] + ["w" * 300]
    rows = [(i if i % 17 else None, None if i == 5 else " ,".join(rng.choices(vocabulary, k=rng.choice((0, 3, 19, 20, 60))))) for i in range(300)]
    target = [" ".join(rng.choices(vocabulary[:30], k=80)) for _ in range(9)] + [None, ""]
    d = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in rows], docs(spark).schema).repartition(5)
    b = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resampled(d, b, percent=30, longest=longest, buckets=500).collect()
    want = plain(rows, target, 1, longest, 30, 20, 2024, 500)
    # rows without id tie with each other only by score, so their ranks may swap
    key = lambda r: (r[0], r[1], r[2], r[3], r[4] if r[0] is not None else r[4] is None)
    assert sorted((key(tuple(r)) for r in got), key=str) == sorted(map(key, want), key=str)
    ranks = sorted(r.rank for r in got if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else 9) for i in range(500)] + [(None, 7), (3, 9)], "doc_id long, score long")
    from pyspark.sql import functions as F
    got = resampling.ranked(rows.repartition(7), [F.desc("score"), F.asc_nulls_last("doc_id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 503))
    assert [(r.score, r.doc_id) for r in got] == sorted(((r.score, r.doc_id) for r in got), key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def test_odd_rows(spark):
    b = spark.createDataFrame([(1, "lorem ipsum"), (2, None)], "item_id long, text string")
    got = resampling.resampled(docs(spark), b)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert set(got.dtypes[1:]) == {(c, "bigint") for c in got.columns[1:]}
    rows = got.collect()
    assert len(rows) == 8 and all(r.rank is None for r in rows)
    assert {r.doc_id: r.n_features for r in rows}[4] == 100_000 and sum(r.n_features == 0 and r.weight == 0 for r in rows) == 3
    assert resampling.resampled(docs(spark), b.limit(0), percent=100).where("rank is not null").count() == 1
    assert resampling.resampled(none(spark), b).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_sql(spark):
    from authorlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.oracle()}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in QUERIES["op13_resampling"](spark, sf).orderBy("doc_id").collect()]
    assert got == want and sum(r[4] is not None for r in got) > 5
