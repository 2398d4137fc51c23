"""Annotated lines per submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from authorlens.functions import annotate
from authorlens.functions.text import how_many, is_blank, lines_of, unnest
from authorlens.operators.features import with_language


def with_annotations(df: DataFrame, cap: bool = True) -> DataFrame:
    """Adds ``line_annotations ARRAY<STRUCT<line,tone,note>>``; a narrow step."""
    out = df if "detected_language" in df.columns else with_language(df)
    out = out.withColumn("_al", lines_of(F.col("code")))
    out = out.withColumn("line_annotations", annotate.all_annotations(F.col("_al"), F.col("detected_language")))
    if cap:
        out = out.withColumn("line_annotations", annotate.capped(
            F.col("line_annotations"), how_many(F.col("_al"), lambda l: ~is_blank(l))))
    return out.drop("_al")


def annotations(df: DataFrame, cap: bool = True) -> DataFrame:
    """Relation ``(id, line, tone, note)``."""
    return unnest(with_annotations(df, cap), ["id"], "line_annotations").select("id", "_e.*")


def annotation_counts(df: DataFrame) -> DataFrame:
    notes = F.col("line_annotations")
    return with_annotations(df).select(
        "id", annotate.tone_count(notes, "red").alias("red"), annotate.tone_count(notes, "amber").alias("amber"))


def annotated_source(df: DataFrame) -> DataFrame:
    """Every line of every text with its annotation, if any: ``(id, line, text, tone, note)``."""
    found = F.map_from_entries(F.transform("line_annotations", lambda a: F.struct(a["line"], a)))
    rows = unnest(with_annotations(df).withColumn("_l", lines_of(F.col("code"))), ["id", found.alias("_m")], "_l", "_p")
    line = (F.col("_p") + 1).cast("bigint")
    note = F.try_element_at("_m", line)
    return rows.select("id", line.alias("line"), F.col("_e").alias("text"), note["tone"].alias("tone"), note["note"].alias("note"))
