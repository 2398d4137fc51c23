"""Embedding near-duplicates: an exact metric range join.

On unit vectors, cosine >= c is Euclidean distance <= r with r = sqrt(2 - 2c).  Every vector
belongs to the cell of its nearest pivot.  A pair within r of each other is met in the cell of
one of the two: x is also sent to another cell if the triangle inequality allows a partner
there, that is if d(x, pivot) <= r + (largest distance of the cell's own vectors) and
d(x, pivot) - d(x, own pivot) <= 2r.  Of two cells, the one with the higher number sends, so a
pair is met once.

Cells join independently, and a cell is dealt in blocks of ``BLOCK`` vectors: each block of its
own vectors meets each block of those sent there, as a matrix product in double precision.  No
pair leaves a block: links are counted per vector, and only a spanning forest goes on to the
components.  So a cell of a third of all vectors is many small tasks.

Equal vectors are joined once and weigh as many as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from authorlens.operators.graph import components
from authorlens.session import cut_lineage

COSINE = 0.95
#: The pivots are drawn from so many distinct vectors at most; they only steer the partition.
SAMPLE = 4_096
MOST_PIVOTS = 1_024
BLOCK = 4_096
ROWS = 256  # of a block, compared at once
ROUNDING = 1e-9


def _unit_rows(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(column: str):
    """True for vectors that can link: no null or non-finite component, and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(column) > 0) & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0), F.lit(False))


def pivots(vectors: DataFrame, count: int, dims: int) -> np.ndarray:
    """About sqrt(count) / 8 pivots of a bounded sample, each the farthest from those before it."""
    wanted = max(1, min(MOST_PIVOTS, math.ceil(math.sqrt(count) / 8)))
    share = min(1.0, SAMPLE / max(1, count))
    drawn = vectors.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))))
    rows = drawn.select("embedding").limit(2 * SAMPLE).collect()
    if not rows:
        return np.empty((0, dims))
    x = _unit_rows([r["embedding"] for r in rows])
    x = x[np.lexsort(x.T)]
    chosen, nearest = [0], 1 - x @ x[0]
    while len(chosen) < min(wanted, len(x)):
        far = int(nearest.argmax())
        if nearest[far] <= ROUNDING:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, 1 - x @ x[far])
    return x[chosen]


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ p.T)))


def _own_cells(shared):
    def run(batches):
        p = shared.value
        for b in batches:
            d = _distances(_unit_rows(b.column(1).to_pylist()), p) if b.num_rows else np.empty((0, len(p)))
            own = d.argmin(1) if len(d) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])],
                                             [*b.schema.names, "cell", "near"])
    return run


def _boundary(shared, r):
    """Cells below a vector's own one that may hold a partner."""
    def run(batches):
        p, reach = shared.value
        for b in batches:
            cell, near = b.column(1).to_numpy(), b.column(3).to_numpy()
            d = _distances(_unit_rows(b.column(2).to_pylist()), p) if b.num_rows else np.empty((0, len(p)))
            sent = (d <= reach + r + ROUNDING) & (d - near[:, None] <= 2 * r + ROUNDING) & (np.arange(len(p)) < cell[:, None])
            row, to = np.nonzero(sent)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(to.astype(np.int32)), b.column(2).take(pa.array(row))],
                                             ["node", "cell", "embedding"])
    return run


def _join_block(cosine):
    """Own vectors of a cell's block against one block of it: link counts, and a spanning forest of the links."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, weight, role = (table.column(c).to_numpy() for c in ("node", "weight", "role"))
        x = _unit_rows(table.column("embedding").to_pylist())
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role != 0)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        inside = role[b] == 1  # of the cell itself: met from both sides, so only pairs in order count
        for lo in range(0, len(a), ROWS):
            rows = a[lo:lo + ROWS]
            near = x[rows] @ x[b].T >= cosine
            near &= ~inside | (node[b] > node[rows][:, None])
            if not near.any():
                continue
            links[rows] += near @ weight[b]
            links[b] += weight[rows] @ near
            for i in np.flatnonzero(near.any(1)):
                # everything near joins the least root among them
                touched = np.unique(root[np.append(b[near[i]], rows[i])])
                root[np.isin(root, touched)] = touched[0]
        other = node[root]
        # a node occurs in both roles: its occurrences are tied by the node itself
        some = (links > 0) | (other != node)
        return pa.table({"node": pa.array(node[some]), "other": pa.array(other[some]), "links": pa.array(links[some])})
    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing
    and are their own component; vectors of different lengths never link.  Rows with equal
    vectors link with each other.  A null vec_id is its own component unless it has links.
    """
    r = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), usable(vector_col).alias("ok"))
    good = rows.where("ok").withColumn("key", F.sha2(F.to_json(F.struct("embedding")), 256))
    distinct = cut_lineage(good.groupBy("key").agg(F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
                           .withColumn("node", F.xxhash64("key")).withColumn("dims", F.size("embedding")))
    found, ties = None, None
    for row in distinct.groupBy("dims").count().collect():  # as many as there are vector lengths
        some = distinct.where(F.col("dims") == row["dims"])
        part = _join_cells(some, pivots(some, row["count"], row["dims"]), cosine, r, block)
        found = part if found is None else found.unionByName(part)
    loose = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is None:
        return loose.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    found = cut_lineage(found)
    roots = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (distinct.select("key", "node", "weight", "least").join(roots, "node", "left").join(counts, "node", "left")
             .select("key", F.coalesce("root", "node").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    leasts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = good.select("vec_id", "key").join(named.join(leasts, "root").select("key", "n_links", "component_id"), "key")
    out = linked.select("vec_id", "n_links", "component_id").unionByName(loose)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _join_cells(distinct: DataFrame, p: np.ndarray, cosine: float, r: float, block: int) -> DataFrame:
    """(node, other, links) from every block of every cell."""
    sc = distinct.sparkSession.sparkContext
    kind = distinct.schema["embedding"].dataType.simpleString()
    slim = distinct.select("node", "embedding", "weight")
    owned = cut_lineage(slim.mapInArrow(_own_cells(sc.broadcast(p)), f"node long, embedding {kind}, weight long, cell int, near double"))
    cells = {c["cell"]: c for c in owned.groupBy("cell").agg(F.max("near").alias("reach"), F.count("*").alias("n")).collect()}  # a row per pivot
    reach = np.array([cells[i]["reach"] if i in cells else -math.inf for i in range(len(p))])
    sent = owned.select("node", "cell", "embedding", "near").mapInArrow(
        _boundary(sc.broadcast((p, reach)), r), f"node long, cell int, embedding {kind}").join(slim.select("node", "weight"), "node")
    sent = sent.select("node", "cell", "embedding", "weight")
    extra = {c["cell"]: c["count"] for c in sent.groupBy("cell").count().collect()}
    blocks = lambda n: max(1, math.ceil(n / block))
    own_blocks = {i: blocks(c["n"]) for i, c in cells.items()}
    all_blocks = {i: blocks(c["n"] + extra.get(i, 0)) for i, c in cells.items()}
    known = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("cell"))
    spread = lambda n: F.pmod(F.xxhash64("node", "cell"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a, b = known(own_blocks), known(all_blocks)
    columns = ["node", "cell", "embedding", "weight"]
    own = owned.select(*columns, F.lit(0).alias("role"), spread(a).alias("i"), upto(b).alias("j"))
    inner = owned.select(*columns, F.lit(1).alias("role"), spread(b).alias("j"), upto(a).alias("i"))
    outer = sent.select(*columns, F.lit(2).alias("role"), spread(b).alias("j"), upto(a).alias("i"))
    return own.unionByName(inner).unionByName(outer).groupBy("cell", "i", "j").applyInArrow(_join_block(cosine), "node long, other long, links long")
