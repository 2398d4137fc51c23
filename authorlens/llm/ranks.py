"""Gapless numbers inside groups, without ever holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from authorlens.session import cut_lineage


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with a column ``name``: 0, 1, 2, ... within each value of ``group``.

    The rows are checkpointed, which fixes the partition each one is in; a group's rows of one
    partition are numbered by a window, on top of how many earlier partitions hold.  Only the
    counts of (group, partition) are summed by group.  Rows that tie are equal and may swap.
    """
    rows = cut_lineage(rows.withColumn("part__", F.spark_partition_id()))
    parts = rows.groupBy(group, "part__").agg(F.count("*").alias("n__"))
    before = Window.partitionBy(group).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select(F.col(group).alias("of__"), F.col("part__").alias("at__"), F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("first__"))
    inner = rows.withColumn("rank__", F.row_number().over(Window.partitionBy(group, "part__").orderBy(*order)))
    joined = inner.join(firsts, (F.col(group).eqNullSafe(F.col("of__"))) & (F.col("part__") == F.col("at__")))
    return joined.withColumn(name, F.col("first__") + F.col("rank__") - 1).drop("part__", "of__", "at__", "first__", "rank__")
