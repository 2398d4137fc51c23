"""Rounds against a plain version with Python's integers, bounds that never change a result, odd rows, the SQL twin."""

import hashlib
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from authorlens.llm import clusters

rng = random.Random(12)
SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def plain(rows, k=8, rounds=10, seed=3, dims=64):
    good = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows
            if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centers = [x for _, x in sorted(good, key=key)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    assign = lambda: [min((far(x, c), n) for n, c in enumerate(centers)) for _, x in good]
    for _ in range(rounds):
        at = assign()
        for n in range(len(centers)):
            own = [x for (_, x), (_, m) in zip(good, at) if m == n]
            if own:
                centers[n] = [sum(v) // len(own) for v in zip(*own)]
    at = assign()
    fits = lambda v: v if v <= 2 ** 63 - 1 else None
    out = []
    for (i, _), (d, n) in zip(good, at):
        own = [e for e, m in at if m == n]
        short = lambda some: None if any(fits(e) is None for e in some) else fits(sum(some))
        out.append((i, n, fits(d), short(own), short([e for e, _ in at]), hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()))
    return sorted(out, key=str)


def vectors(n, dims, spread=1.0):
    heart = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [[c + rng.gauss(0, spread) for c in rng.choice(heart)] for _ in range(n)]


@pytest.mark.parametrize("dims, spread", [(64, 1.0), (64, 0.05), (3, 0.5)])
def test_rounds(spark, dims, spread):
    some = vectors(150, dims, spread)
    some += some[:20] * 3 + [[0.0] * dims] * 40  # equal vectors tie
    rows = [(i, x) for i, x in enumerate(some)]
    d = spark.createDataFrame([(i, x, 1, "x") for i, x in rows], SCHEMA).repartition(5)
    got = clusters.clustered(d, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, dims=dims)


@pytest.mark.parametrize("scale", [1.0, 2.0 ** 17, 1e30])
def test_components_of_any_size(spark, scale):
    """Beyond 2 ** 27 the arithmetic is Python's; distances that a long cannot hold are null."""
    rows = [(i, [v * scale for v in x]) for i, x in enumerate(vectors(40, 4))] + [(99, [0.1, 0.2, 0.3, 0.4])]
    got = clusters.clustered(spark.createDataFrame([(i, x, 1, "x") for i, x in rows], SCHEMA), centroids=3, rounds=4, dims=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, k=3, rounds=4, dims=4)


def test_bounds_spare_distances_and_change_none():
    some = np.concatenate([np.array(vectors(300, 64, 0.02)) for _ in range(1)])
    x = clusters.integers(some)
    pivots = clusters.chosen_pivots(x[:100], 8)
    now = clusters.Centroids.of(x[::40].tolist(), pivots)
    table = np.stack([clusters.roots(clusters.squared(x, p)) for p in pivots], 1)
    best, d, measured = clusters.nearest(x, table, now)
    every = np.stack([clusters.squared(x, c) for c in now.vectors], 1)
    assert (best == every.argmin(1)).all() and (d == every.min(1)).all()
    assert measured < 0.6 * every.size


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 3), (None, [0.25] * 3), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]), (6, [0.0, inf, 0.0]),
            (7, [0.0] * 4), (8, [0.0, -0.0, 0.0]), (8, [0.0, -0.0, 0.0]), (9, [-0.0001, 1e-9, 3.0])]
    d = spark.createDataFrame([(i, x, None, "x") for i, x in rows], SCHEMA)
    got = clusters.clustered(d, dims=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, dims=3)
    empty = clusters.clustered(d.limit(0), dims=3)
    assert empty.count() == 0 and empty.schema.simpleString() == clusters.clustered(d, dims=3).schema.simpleString()


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_sql(spark):
    from authorlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT * FROM ({clusters.oracle()}) ORDER BY vec_id").fetchall()
    got = [tuple(r) for r in QUERIES["op12_clusters"](spark, sf).orderBy("vec_id").collect()]
    assert got == want and len({r[1] for r in got}) > 3
