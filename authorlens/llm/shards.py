"""Shards by a k-d tree over metadata, with DataFrame functions only.

Law ``bytes``: shards get nearly equal bytes, and equal texts one shard.

The tree works on groups of equal texts.  A group larger than ``LARGE`` of a shard's share is
placed first, on the shard with the most room, and takes that room; one larger than a share
fills whole shards row by row.  There are at most shards / LARGE such groups, so their list is
bounded.  All other groups go down the tree: a node is split along its widest dimension (ranges
as shares of the corpus's range) at the weighted median, where the weight is the room of the
shards on either side, until a leaf is one shard.

The median is found without sorting: a pass sums the bytes of ``BINS`` bins of every node, the
bin that holds the cut is binned again, and so on until what it holds is negligible.  The driver
sees a bin per node.  Ties on a dimension are ordered by a hash of the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from authorlens.llm.ranks import numbered
from authorlens.session import cut_lineage

SHARDS = 16
LARGE = 0.02
NEGLIGIBLE = 0.002  # of a shard's share
BINS = 4096
DIMENSIONS = ("id_at", "size_at", "lang_at", "source_at")
HASH_BITS = 20
VALUE_BITS = 40  # a place is 40 bits of the dimension, then 20 bits of the hash


@dataclass
class Node:
    first: int  # shards first .. last - 1
    last: int
    dim: str = ""
    low: float = 0.0
    wide: float = 1.0
    start: int = 0  # places that the cut may still be at: start .. end - 1
    end: int = 1 << (VALUE_BITS + HASH_BITS)
    below: int = 0  # bytes before start
    cut: int | None = None

    @property
    def middle(self) -> int:
        return (self.first + self.last) // 2


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, group__, and a number in each dimension); the texts stay behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = lambda name: (F.pmod(F.xxhash64(name), F.lit(1 << 30)) if name in docs.columns else F.lit(0)).cast("double")
    key = F.col(id_col).cast("double") if docs.schema[id_col].dataType.typeName() in ("long", "integer", "short") else number(id_col)
    size = (F.octet_length(text) + 1).cast("long")
    return docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("group__"), F.coalesce(key, F.lit(0.0)).alias("id_at"), F.log2(size).alias("size_at"),
        number("lang").alias("lang_at"), number("source").alias("source_at"))


def _choose(column: Column, values: dict[int, object]) -> Column:
    """A constant for each value of a column; at most a few dozen."""
    if not values:
        return F.lit(None)
    return reduce(lambda c, kv: c.when(column == kv[0], F.lit(kv[1])), list(values.items())[1:],
                  F.when(column == next(iter(values)), F.lit(next(iter(values.values())))))


def _place(nodes: dict[int, Node]) -> Column:
    """Where a group stands on its node's dimension: a number of VALUE_BITS + HASH_BITS bits."""
    node, cases = F.col("node"), []
    for i, n in nodes.items():
        share = (F.col(n.dim) - n.low) / n.wide * float((1 << VALUE_BITS) - 1)
        cases.append((i, F.least(F.greatest(share, F.lit(0.0)), F.lit(float((1 << VALUE_BITS) - 1))).cast("long")))
    value = reduce(lambda c, ix: c.when(node == ix[0], ix[1]), cases[1:], F.when(node == cases[0][0], cases[0][1]))
    return value * (1 << HASH_BITS) + F.col("hash")


def _widest(groups: DataFrame, nodes: dict[int, Node], whole: dict[str, float]) -> None:
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    for r in groups.groupBy("node").agg(*ends).collect():
        n = nodes[r["node"]]
        n.dim = max(DIMENSIONS, key=lambda d: ((r[f"max_{d}"] - r[f"min_{d}"]) / whole[d], d))
        n.low, n.wide = r[f"min_{n.dim}"], max(r[f"max_{n.dim}"] - r[f"min_{n.dim}"], 1e-300)


def _cut(groups: DataFrame, nodes: dict[int, Node], room: list[float], target: float) -> None:
    """Find every node's cut, all nodes in each pass."""
    placed = groups.select("node", "bytes", _place(nodes).alias("place"))
    totals = {r["node"]: r["n"] for r in placed.groupBy("node").agg(F.sum("bytes").alias("n")).collect()}
    wanted = {}
    for i, n in nodes.items():
        whole = sum(room[n.first:n.last])
        wanted[i] = totals.get(i, 0) * (sum(room[n.first:n.middle]) / whole if whole > 0 else 0.5)
    searching = {i: n for i, n in nodes.items() if i in totals}
    for n in nodes.values():
        n.cut = 0
    while searching:
        start = _choose(F.col("node"), {i: n.start for i, n in searching.items()})
        step = _choose(F.col("node"), {i: max(1, -(-(n.end - n.start) // BINS)) for i, n in searching.items()})
        end = _choose(F.col("node"), {i: n.end for i, n in searching.items()})
        inside = placed.where((F.col("place") >= start) & (F.col("place") < end))
        bins = inside.groupBy("node", F.floor((F.col("place") - start) / step).alias("bin")).agg(F.sum("bytes").alias("n"))
        sums = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("node").orderBy("bin")))
        need = _choose(F.col("node"), {i: wanted[i] - n.below for i, n in searching.items()})
        crossing = sums.where(F.col("upto") >= need).groupBy("node").agg(F.min(F.struct("bin", "n", "upto")).alias("b"))
        found = {r["node"]: r["b"] for r in crossing.collect()}
        for i, n in list(searching.items()):
            if i not in found:
                n.cut = n.end
                del searching[i]
                continue
            b, width = found[i], max(1, -(-(n.end - n.start) // BINS))
            n.below += b["upto"] - b["n"]
            n.start, n.end = n.start + b["bin"] * width, min(n.end, n.start + (b["bin"] + 1) * width)
            if b["n"] <= NEGLIGIBLE * target or width == 1:
                over = n.below + b["n"] - wanted[i]
                n.cut = n.end if over < wanted[i] - n.below else n.start
                del searching[i]


def _large(groups: DataFrame, share: float) -> list[tuple[str, int, int]]:
    """(group, bytes, rows) of groups above LARGE of a share, largest first: at most SHARDS / LARGE."""
    rows = groups.where(F.col("bytes") > LARGE * share).select("group__", "bytes", "rows").collect()
    return sorted(((r["group__"], r["bytes"], r["rows"]) for r in rows), key=lambda r: (-r[1], r[0]))


def assigned(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` of ``sized`` with a column ``shard``.

    A row counts at least one byte, so empty texts weigh too; all rows null or equal, or fewer
    rows than shards, is no special case.  An empty table gives none.
    """
    rows = cut_lineage(rows)
    groups = cut_lineage(rows.groupBy("group__").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), *[F.min(d).alias(d) for d in DIMENSIONS],
        F.pmod(F.xxhash64("group__"), F.lit(1 << HASH_BITS)).alias("hash"), F.lit(1).alias("node")))
    ends = groups.agg(F.sum("bytes").alias("n"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).first()
    share = (ends["n"] or 0) / shards
    whole = {d: ends[d] or 1.0 for d in DIMENSIONS}
    room, homes, split = [share] * shards, {}, {}
    for name, size, count in _large(groups, share):
        if size > share and count > 1:
            # row by row over the shards with the most room, to fill each of them
            each, left, takes = size / count, count, []
            for s in sorted(range(shards), key=lambda s: -room[s]):
                n = min(left, max(0, round(room[s] / each)))
                if n:
                    takes.append((s, n))
                    room[s] -= n * each
                    left -= n
            if left:
                takes.append((max(range(shards), key=lambda s: room[s]), left))
            split[name] = takes
        else:
            s = max(range(shards), key=lambda s: room[s])
            homes[name] = s
            room[s] -= size
    room = [max(0.0, r) for r in room]
    taken = [*homes, *split]
    small = groups.where(~F.col("group__").isin(taken)) if taken else groups
    nodes = {1: Node(0, shards)}
    leaves = {}
    while nodes:
        small = cut_lineage(small)
        _widest(small, nodes, whole)
        alive = {i: n for i, n in nodes.items() if n.dim}
        if not alive:
            break
        _cut(small, alive, room, max(share, 1.0))
        place = _place(alive)
        small = small.withColumn("node", F.when(F.col("node").isin(list(alive)), F.col("node") * 2 + (
            place >= _choose(F.col("node"), {i: n.cut for i, n in alive.items()})).cast("int")).otherwise(F.col("node")))
        after = {}
        for i, n in alive.items():
            for child, (a, b) in ((2 * i, (n.first, n.middle)), (2 * i + 1, (n.middle, n.last))):
                if b - a == 1:
                    leaves[child] = a
                else:
                    after[child] = Node(a, b)
        nodes = after
    shard = small.select("group__", _choose(F.col("node"), leaves).cast("int").alias("home")) if leaves else small.select(
        "group__", F.lit(0).alias("home"))
    if homes:
        fixed = groups.where(F.col("group__").isin(list(homes)))
        shard = shard.unionByName(fixed.select("group__", _choose(F.col("group__"), homes).cast("int").alias("home")))
    whole_groups = rows.where(~F.col("group__").isin(list(split))) if split else rows
    out = whole_groups.join(shard.withColumnRenamed("home", "shard"), "group__")
    if split:
        ranked = numbered(rows.where(F.col("group__").isin(list(split))), "group__", ["doc_id"], "nth")
        upto, case = {}, F
        for name, takes in split.items():
            upto[name], n = [], 0
            for s, k in takes:
                n += k
                upto[name].append((n, s))
        for name, steps in upto.items():
            for n, s in steps:
                case = case.when((F.col("group__") == name) & (F.col("nth") < n), s)
        out = out.unionByName(ranked.withColumn("shard", case.cast("int")).drop("nth"))
    return out


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; repeated rows stay rows."""
    rows = assigned(sized(docs), shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    return numbered(rows, "shard", ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
