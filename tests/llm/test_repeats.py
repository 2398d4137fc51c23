"""Removed words against a plain version at several group sizes, the parts of the tree, odd rows, the SQL twin."""

import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from authorlens.llm import repeats
from tests.llm.odd import docs, none

rng = random.Random(11)


def plain(rows, width):
    """(doc_id, n_words, removed word numbers, kept) by remembering the first place of every window."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    sha = [hashlib.sha256(" ".join(w).encode()).digest() for w in words]
    place = lambda i, h, k: (i is None, i or 0, h, k)
    first = {}
    for (i, _), w, h in zip(rows, words, sha):
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, place(i, h, k)), place(i, h, k))
    out = []
    for (i, _), w, h in zip(rows, words, sha):
        gone = {x for k in range(len(w) - width + 1) if first[tuple(w[k:k + width])] < place(i, h, k) for x in range(k, k + width)}
        out.append((i, len(w), sorted(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def texts(n, width):
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(60)]
    passages = [rng.choices(vocabulary, k=rng.choice((width, width + 3, 4 * width))) for _ in range(6)]
    out = []
    for _ in range(n):
        w = rng.choices(vocabulary, k=rng.choice((0, 2, width - 1, width, 5 * width)))
        for _ in range(rng.choice((0, 1, 1, 3))):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        if rng.random() < 0.1:
            w += ["same"] * rng.choice((width - 1, width, width + 7))
        out.append(rng.choice((" ", "\n", " \t ")).join(w))
        if rng.random() < 0.15:
            out.append(" ".join(out[-1].split()))  # a copy, with other blanks
    return out


@pytest.mark.parametrize("group, chunk", [(500_000, 500_000), (40, 500_000), (40, 300), (3, 60)])
def test_removed_words(spark, group, chunk):
    """Small groups make long prefixes and salted windows; small chunks make equal windows meet in the shuffle."""
    width = 6
    rows = [(None if i % 23 == 7 else (i * 7919) % 1009 if i % 11 else 5, t) for i, t in enumerate(texts(160, width))]
    rows += rows[:9] * 2
    d = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in rows], docs(spark).schema).repartition(4)
    got = repeats.deduplicated(d, width, sizes=repeats.Sizes(group, chunk)).collect()
    flat = sorted(((r.doc_id, r.n_words, [x for s in r.spans for x in range(s.start, s.end)], r.kept) for r in got), key=str)
    assert flat == plain(rows, width)
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))  # spans are maximal


def test_long_prefixes_reach_every_depth(spark):
    sizes = repeats.Sizes(5, 40)
    passage = " ".join(f"p{i}" for i in range(30))
    d = spark.createDataFrame([(i, f"own{i} {passage} end{i}", None, None, None, None, None) for i in range(60)], docs(spark).schema).repartition(6)
    reps = repeats.cut_lineage(repeats.marks(d, 20, "doc_id", "text").select("doc_id", F.col("tie").alias("rep"), "anchors"))
    grams = repeats.shared_anchors(reps, sizes).groupBy("rep").agg(F.collect_set("gram").alias("grams"))
    parts = repeats.cut_lineage(repeats.segments(repeats._carried(d, "doc_id", "text").join(reps, "doc_id").join(grams, "rep"), 20, sizes))
    frequent, many = repeats.long_prefixes(parts, 20, sizes)
    assert many and {d for d, p in frequent.items() if p} == {1, 2, 3, 4, 6, 9, 14, 20}
    got = repeats.deduplicated(d, sizes=sizes).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [f"own0 {passage} end0"] + [f"own{i} end{i}" for i in range(1, 60)]


def test_nodes_of_the_tree():
    letters = np.array([[1, 1, 1], [1, 1, 2], [1, 1, 1], [3, 1, 1], [1, 1, 1]], np.uint8)
    s = repeats.Suffixes(3, letters=letters, tails=np.array([9, 4, 9, 4, 8], np.uint64), ids=np.array([5, 1, 2, 1, 0]),
                         reps=np.arange(5), starts=np.array([0, 0, 7, 1, 3], np.int32))
    tree, node = s.nodes()
    assert tree.reps.tolist() == [4, 2, 0, 1, 3] and node.tolist() == [0, 1, 1, 2, 3]  # 4 has the letters of 2 and 0, not their words
    firsts, later = s.split()
    assert sorted(firsts.reps.tolist()) == [1, 2, 3, 4] and later.reps.tolist() == [0]


def test_equal_windows_have_equal_anchors():
    codes = np.array(rng.choices(range(1, 5), k=400), np.uint64) * repeats.ODD
    grams = repeats.run_hashes(codes, 4)
    places, whole = repeats.anchors(grams, 9), repeats.run_hashes(codes, 12)
    assert all(places[i] == i + int(np.argmin(grams[i:i + 9])) for i in range(len(places)))
    seen = {}
    for i, h in enumerate(whole.tolist()):
        assert seen.setdefault(h, (tuple(codes[i:i + 12]), places[i] - i)) == (tuple(codes[i:i + 12]), places[i] - i)


def test_odd_rows(spark):
    got = repeats.digest(docs(spark))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and dict(got.dtypes)["n_removed"] == "bigint"
    rows = {(r.doc_id, r.n_words, r.n_removed) for r in got.collect()}
    # the long text says five words over and over: its first 20-word windows at each of five places stay
    assert rows == {(1, 0, 0), (2, 0, 0), (None, 6, 0), (3, 6, 0), (4, 100_000, 99_995), (5, 0, 0), (6, 6, 0)} and got.count() == 8
    assert {r.kept_sha256 for r in got.collect() if not r.n_words} == {hashlib.sha256(b"").hexdigest()}
    assert repeats.digest(none(spark)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_sql(spark):
    from authorlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({repeats.oracle()}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in QUERIES["op11_repeats"](spark, sf).orderBy("doc_id").collect()]
    assert got == want and any(r[2] for r in got)
