"""Centroid clustering of integer vectors with a LAESA pivot table.

A vector's distances to a few fixed pivots are computed once and stored beside it.  Each round
the driver sends the centroids and their distances to the pivots; by the triangle inequality the
greatest difference to a pivot bounds the distance of a vector to a centroid from below.  The
centroid of least bound is measured first; others only if their bound does not exceed that
distance.  What is measured is measured in integers, so ties and sums are exact.

Every task adds up its vectors by centroid and component; Spark adds the tasks' sums, and the
driver gets a number per centroid and component.  A sum is dealt in limbs of ``LIMB`` bits, so no
size of component overflows; components beyond ``NARROW`` are computed with Python's integers.
Groups of equal vectors need no care: no row meets another one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from authorlens.session import cut_lineage

DIMS = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
PIVOTS = 8
#: Pivots are chosen from so many vectors, of smallest hash; they only steer what is measured.
SAMPLE = 512
LIMB = 40
NARROW = 2.0 ** 27  # components below this have squared distances of 64 dimensions below 2 ** 62
PIECE = 8_192  # vectors looked at together
ROUNDING = 1e-9
LARGEST = 2 ** 63 - 1


def kept(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that have ``dims`` components, none null or non-finite (also when scaled)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf"))
    ok = F.coalesce((F.size(vector_col) == dims) & ~F.exists(vector_col, bad), F.lit(False))
    return vectors.where(ok).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): int64, or Python's integers where a component is large."""
    x = np.floor(x.astype(np.float64) * SCALE)
    if not x.size or np.abs(x).max() < NARROW:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one vector."""
    wide = object if x.dtype == object or c.dtype == object else np.int64
    d = x.astype(wide, copy=False) - c.astype(wide, copy=False)
    return (d * d).sum(1)


def roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


@dataclass(frozen=True)
class Centroids:
    vectors: np.ndarray  # a row per centroid
    to_pivots: np.ndarray  # distances, a row per centroid

    @staticmethod
    def of(rows: list[list[int]], pivots: np.ndarray) -> Centroids:
        wide = object if any(abs(v) >= NARROW for r in rows for v in r) else np.int64
        c = np.array(rows, wide)
        return Centroids(c, np.stack([roots(squared(c, p)) for p in pivots], 1))


def nearest(x: np.ndarray, to_pivots: np.ndarray, now: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, ties to the smaller number; and how many distances were measured."""
    bound = np.zeros((len(x), len(now.vectors)))
    for p in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p:p + 1] - now.to_pivots[:, p]), out=bound)
    scale = to_pivots.max(1, initial=0) + now.to_pivots.max(initial=0)
    bound -= ROUNDING * (1 + scale[:, None])  # of the roots and of their difference
    first = bound.argmin(1)
    wide = object if x.dtype == object or now.vectors.dtype == object else np.int64
    d = np.zeros(len(x), wide)
    for c in range(len(now.vectors)):
        rows = np.flatnonzero(first == c)
        d[rows] = squared(x[rows], now.vectors[c])
    best, measured = first.copy(), len(x)
    for c in range(len(now.vectors)):
        rows = np.flatnonzero((first != c) & (bound[:, c] <= roots(d) * (1 + ROUNDING)))
        new = squared(x[rows], now.vectors[c])
        better = (new < d[rows]) | ((new == d[rows]) & (c < best[rows]))
        d[rows[better]], best[rows[better]] = new[better], c
        measured += len(rows)
    return best, d, measured


def _pieces(b: pa.RecordBatch, dims: int):
    for lo in range(0, b.num_rows, PIECE):
        part = b.slice(lo, PIECE)
        yield part, integers(matrix(part.column("embedding"), dims))


def pivot_table(rows: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """``rows`` with the distances to the pivots, computed once."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    kind = {c: t for c, t in rows.dtypes}

    def run(batches):
        for b in batches:
            for part, x in _pieces(b, dims):
                d = np.stack([roots(squared(x, p)) for p in shared.value], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), lists], ["vec_id", "embedding", "to_pivots"])
    return rows.mapInArrow(run, f"vec_id {kind['vec_id']}, embedding {kind['embedding']}, to_pivots array<double>")


def sums(table: DataFrame, now: Centroids, dims: int) -> dict[int, tuple[int, list[int]]]:
    """(vectors, component sums) of every centroid that has any, exact."""
    shared = table.sparkSession.sparkContext.broadcast(now)

    def run(batches):
        counts, totals = defaultdict(int), {}
        for b in batches:
            for part, x in _pieces(b, dims):
                best, _, _ = nearest(x, matrix(part.column("to_pivots"), shared.value.to_pivots.shape[1]), shared.value)
                for c in np.unique(best).tolist():
                    own = x[best == c]
                    counts[c] += len(own)
                    totals[c] = [a + int(s) for a, s in zip(totals.get(c, [0] * dims), own.sum(0))]
        rows = [(c, -1, 0, n) for c, n in counts.items()]  # component -1 counts
        for c, total in totals.items():
            for k, value in enumerate(total):
                limb = 0
                while value not in (0, -1):
                    rows.append((c, k, limb, value & ((1 << LIMB) - 1)))
                    value, limb = value >> LIMB, limb + 1
                rows.append((c, k, limb, value))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()),
                                          pa.array(columns[3], pa.int64())], ["cluster", "component", "limb", "value"])
    parts = (table.select("embedding", "to_pivots").mapInArrow(run, "cluster int, component int, limb int, value long")
             .groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect())
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts:  # centroids x components x limbs
        n, total = found.get(r["cluster"], (0, [0] * dims))
        if r["component"] < 0:
            n += r["value"]
        else:
            total[r["component"]] += r["value"] << (LIMB * r["limb"])
        found[r["cluster"]] = (n, total)
    return found


def chosen_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the sample, each farthest from those before it."""
    picked, near = [0], roots(squared(sample, sample[0]))
    while len(picked) < count and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, roots(squared(sample, sample[picked[-1]])))
    return sample[picked]


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS,
              id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Vectors that are null, of another length, or hold null or non-finite components give no row.
    Fewer kept vectors than centroids make fewer centroids, none gives no row.  Repeated rows
    stay rows; rows of one id draw in the order of their components; a null id draws last.  A
    distance or inertia that a long cannot hold is null.
    """
    rows = kept(vectors, dims, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, cluster int, distance long"
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(draw.asc_nulls_last(), "embedding").limit(max(SAMPLE, centroids)).collect()  # at most SAMPLE rows
    if not first:
        return vectors.sparkSession.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")
    start = [integers(np.array([r["embedding"]], np.float64))[0] for r in first]
    wide = object if any(s.dtype == object for s in start) else np.int64
    pivots = chosen_pivots(np.stack([s.astype(wide) for s in start]), PIVOTS)
    now = Centroids.of([[int(v) for v in s] for s in start[:centroids]], pivots)
    table = cut_lineage(pivot_table(rows, pivots, dims))
    for _ in range(rounds):
        found = sums(table, now, dims)
        now = Centroids.of([[t // found[c][0] for t in found[c][1]] if c in found else [int(v) for v in old] for c, old in enumerate(now.vectors)], pivots)
    shared = table.sparkSession.sparkContext.broadcast(now)

    def run(batches):
        for b in batches:
            for part, x in _pieces(b, dims):
                best, d, _ = nearest(x, matrix(part.column("to_pivots"), shared.value.to_pivots.shape[1]), shared.value)
                d = pa.array([v if v <= LARGEST else None for v in map(int, d)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best.astype(np.int32)), d], ["vec_id", "cluster", "distance"])
    given = cut_lineage(table.mapInArrow(run, out))
    total = {r["cluster"]: None if r["lost"] else int(r["n"]) for r in given.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("n"), F.max(F.col("distance").isNull()).alias("lost")).collect()}  # a row per centroid
    whole = None if None in total.values() else sum(total.values())
    long = lambda v: F.lit(v if v is not None and v <= LARGEST else None).cast("long")
    names = {c: hashlib.sha256(",".join(str(int(v)) for v in now.vectors[c]).encode()).hexdigest() for c in range(len(now.vectors))}
    known = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return given.select("*", known([long(total.get(c)) for c in names]).alias("cluster_inertia"), long(whole).alias("inertia"),
                        known([F.lit(names[c]) for c in names]).alias("centroid_sha256"))


def oracle() -> str:
    """The same in SQL, the rounds written one after the other."""
    distance = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    sql = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings
WHERE len(embedding) = {DIMS} AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1)::INT AS cluster, x AS c FROM v
QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) <= {CENTROIDS})"""]
    for k in range(ROUNDS + 1):
        sql.append(f"a{k} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(({distance}, cluster)) AS m FROM v, c{k} GROUP BY vec_id)")
        if k < ROUNDS:
            sql.append(f"""s{k} AS (SELECT cluster, i, sum(e) AS s, count(*) AS n FROM
(SELECT m[2] AS cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL)""")
            sql.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(any_value(l), any_value(o.c)) AS c FROM c{k} o LEFT JOIN
(SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS l FROM s{k} GROUP BY cluster) f ON f.cluster = o.cluster GROUP BY o.cluster)""")
    return f"""WITH {', '.join(sql)} SELECT vec_id, cluster, m[1] AS distance, (sum(m[1]) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
(sum(m[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON cluster = m[2]"""
