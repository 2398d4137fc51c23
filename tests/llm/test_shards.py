"""Near-equal shards, whole groups of copies, gapless slots; and very large groups."""

from collections import defaultdict
from pathlib import Path
from zlib import crc32

import pytest

from authorlens.llm import shards
from tests.llm.odd import docs, none


def held(rows, whole=True, spread=1.02):
    size, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if whole:
        assert all(len(h) == 1 for h in homes.values())
    mean = sum(size.values()) / 16
    assert set(size) == set(range(16)) and max(size.values()) <= spread * mean and min(size.values()) >= mean * (2 - spread)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shards.sharded(d).collect()
    held(rows)
    texts = {r.doc_id: r.text for r in d.collect()}
    assert len(rows) == len(texts) and all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, crc32(texts[r.doc_id].encode())) for r in rows)


def test_a_third_are_copies(spark):
    rows = [(i, "same text again" if i % 3 == 0 else f"text {i} " + "x" * (i % 50), "en", "s", 1, None, None) for i in range(6_000)]
    rows += [(None, "null id", None, None, None, None, None)] * 300
    held(shards.sharded(docs(spark, rows)).collect(), whole=False)


def test_odd_rows(spark):
    rows = shards.sharded(docs(spark)).collect()
    assert len(rows) == 8 and all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16 for r in rows)
    assert shards.sharded(none(spark)).count() == 0
