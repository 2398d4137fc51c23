"""Joins against tables of unique keys when the other side repeats some keys very often."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 1e-4  # a key above this share of all occurrences is hot: at most 1 / HOT_SHARE keys are
SCATTER = 4096


def lookup(left: DataFrame, table: DataFrame, key: str, value: str, weight: str, spread_by: str) -> DataFrame:
    """Left join that adds ``value`` of ``table(key, value, weight)``, safe for hot keys.

    Hot keys are broadcast (a table of at most 1 / HOT_SHARE rows whatever the data).  The
    rows they serve get a second join key that matches nothing and scatters them, so the
    shuffled join of the other keys has no hot task.
    """
    total = table.agg(F.sum(weight).alias("w"))
    hot = table.filter(F.col(weight) >= total.scalar() * HOT_SHARE).select(key, F.col(value).alias("_hot"))
    out = left.join(F.broadcast(hot), key, "left")
    out = out.withColumn("_s", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
        1 + F.pmod(F.xxhash64(spread_by), F.lit(SCATTER)).cast("int")))
    cold = table.select(key, F.col(value).alias("_cold"), F.lit(0).alias("_s"))
    return out.join(cold, [key, "_s"], "left").withColumn(value, F.coalesce("_hot", "_cold")).drop("_s", "_hot", "_cold")
