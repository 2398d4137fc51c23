"""Structure features over ``tree_events(id, seq, delta, type, role, line)``.

One row per opening (+1) and closing (-1); depth is a running sum, so there is no
recursion.  All windows share the partitioning by ``id``: one shuffle serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from authorlens.functions.structure import NESTING, ROLE_NAMES
from authorlens.functions.text import ratio, unnest
from authorlens.operators.features import code_blocks

# Tags that open and close in balance; every other tag is a leaf.
BALANCED = ["head", "title", "style", "script", "nav", "ul", "li", "a", "div", "article", "h1", "footer"]
# The part each tag plays when a page stands for a program.
TAG_ROLES = {"div": "function", "article": "class", "ul": "for", "li": "if", "nav": "while", "script": "try",
             "meta": "import", "b": "lambda"}


def events_from_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """Tags of a page as events; bodies of scripts and styles are left out."""
    bare = F.regexp_replace(F.col(html), r"(?is)(<(script|style)[^>]*>).*?(</\2)", "$1$3")
    marks = F.regexp_extract_all(bare, F.lit(r"\n|</?[a-zA-Z][a-zA-Z0-9]*"), F.lit(0))
    rows = unnest(pages.select("id", marks.alias("m")), ["id"], "m", "pos")
    name = F.lower(F.regexp_replace("_e", r"[</]", ""))
    rows = rows.select("id", (F.col("pos") * 2).cast("bigint").alias("seq"), name.alias("type"),
                       F.startswith("_e", F.lit("</")).alias("shut"), (F.col("_e") == "\n").alias("brk"))
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("line", F.sum(F.col("brk").cast("bigint")).over(before) + 1).filter(~F.col("brk"))
    balanced = F.col("type").isin(BALANCED)
    deltas = (F.when(balanced & F.col("shut"), F.array(F.lit(-1))).when(balanced, F.array(F.lit(1)))
              .when(F.col("shut"), F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(-1))))
    role = None
    for tag, r in TAG_ROLES.items():
        role = F.when(F.col("type") == tag, F.lit(r)) if role is None else role.when(F.col("type") == tag, F.lit(r))
    out = unnest(rows.select("id", "seq", "type", role.alias("role"), "line", deltas.alias("d")),
                 ["id", "seq", "type", "role", "line"], "d", "k")
    return out.select("id", (F.col("seq") + F.col("k")).alias("seq"), F.col("_e").cast("bigint").alias("delta"),
                      "type", "role", "line")


def events_from_code(df: DataFrame) -> DataFrame:
    """Constructs of code as events: each opens before those inside it and closes after them."""
    blocks = code_blocks(df)
    leaf = F.col("opened") == F.col("closed")
    # at one step of the scan: older constructs close (inner first), new ones open, leaves close
    opening = F.struct(F.lit(1).alias("delta"), F.col("start").alias("line"), F.col("opened").alias("tick"),
                       F.lit(1).alias("phase"), leaf.cast("int").alias("turn"))
    closing = F.struct(F.lit(-1).alias("delta"), F.col("finish").alias("line"), F.col("closed").alias("tick"),
                       F.when(leaf, F.lit(2)).otherwise(F.lit(0)).alias("phase"), (-F.col("opened")).alias("turn"))
    ends = unnest(blocks.withColumn("_ends", F.array(opening, closing)),
                  ["id", "node_id", "role"], "_ends").select("id", "node_id", "role", "_e.*")
    w = Window.partitionBy("id").orderBy("tick", "phase", "turn", "node_id")
    return ends.select("id", F.row_number().over(w).cast("bigint").alias("seq"), F.col("delta").cast("bigint").alias("delta"),
                       F.col("role").alias("type"), "role", F.col("line").cast("bigint").alias("line"), "node_id")


def _order() -> Window:
    return Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_depth(events: DataFrame) -> DataFrame:
    """Adds ``depth`` (of all nodes) and ``nest`` (of nesting roles only) after each event."""
    nests = F.coalesce(F.col("role").isin(NESTING), F.lit(False))
    return events.withColumns({
        "depth": F.sum("delta").over(_order()),
        "nest": F.sum(F.when(nests, F.col("delta")).otherwise(F.lit(0))).over(_order()),
    })


def _n(role: str) -> Column:
    return F.count_if((F.col("delta") == 1) & (F.col("role") == role))


def tree_depth(events: DataFrame) -> DataFrame:
    """Depth of the deepest node below an implied root."""
    return with_depth(events).groupBy("id").agg(F.max("depth").cast("bigint").alias("ast_depth"))


def node_types(events: DataFrame) -> DataFrame:
    """Node count and share of distinct node types."""
    opened = events.filter("delta = 1")
    per_type = opened.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))
    return per_type.groupBy("id").agg(F.sum("n").alias("ast_node_count"), F.count(F.lit(1)).alias("n_types")).select(
        "id", "ast_node_count", ratio(F.col("n_types"), F.col("ast_node_count")).alias("unique_node_type_ratio"))


def role_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("id").agg(*[_n(r).alias(f"n_{r}") for r in ROLE_NAMES])


def densities(events: DataFrame, lines: DataFrame) -> DataFrame:
    """Role counts per non-blank line, and nodes per line; ``lines`` is ``(id, filled)``."""
    counts = events.groupBy("id").agg(*[_n(r).alias(f"n_{r}") for r in ROLE_NAMES],
                                      F.count_if(F.col("delta") == 1).alias("_nodes"))
    per = F.greatest("filled", F.lit(1))
    return counts.join(lines, "id").select(
        "id", *[ratio(F.col(f"n_{r}"), per).alias(f"{r}_density") for r in ROLE_NAMES],
        ratio(F.col("_nodes"), per).alias("ast_nodes_per_line"))


def nesting(events: DataFrame) -> DataFrame:
    """Greatest and mean depth among nesting constructs, and the complexity estimate."""
    inside = (F.col("delta") == 1) & F.coalesce(F.col("role").isin(NESTING), F.lit(False))
    out = with_depth(events).groupBy("id").agg(
        F.coalesce(F.max(F.when(inside, F.col("nest"))), F.lit(0)).cast("bigint").alias("max_nesting_depth"),
        F.coalesce(F.avg(F.when(inside, F.col("nest"))), F.lit(0.0)).alias("avg_nesting_depth"),
        *[_n(r).alias(f"n_{r}") for r in ("if", "for", "while", "try", "function")])
    branches = (F.lit(1) + F.col("n_if") + F.col("n_for") + F.col("n_while") + F.col("n_try")).cast("double")
    return out.select("id", "max_nesting_depth", "avg_nesting_depth",
                      F.when(F.col("n_function") > 0, branches / F.greatest("n_function", F.lit(1)))
                      .otherwise(branches).alias("cyclomatic_complexity_approx"))


def spans(events: DataFrame) -> DataFrame:
    """``(id, seq, type, role, start, finish)`` of each node.

    At one depth openings and closings alternate, so the next event at the same level is
    the matching end.
    """
    level = F.when(F.col("delta") == 1, F.col("depth")).otherwise(F.col("depth") + 1)
    paired = with_depth(events).withColumn("level", level)
    w = Window.partitionBy("id", "level").orderBy("seq")
    return paired.withColumn("finish", F.lead("line").over(w)).filter("delta = 1").select(
        "id", "seq", "type", "role", F.col("line").alias("start"), "finish")


def role_lengths(events: DataFrame, role: str = "function") -> DataFrame:
    """Mean and greatest number of lines of the constructs of a role."""
    n = F.col("finish") - F.col("start") + 1
    return spans(events).filter(F.col("role") == role).groupBy("id").agg(
        F.avg(n).alias(f"avg_{role}_length"), F.max(n).alias(f"max_{role}_length"))
