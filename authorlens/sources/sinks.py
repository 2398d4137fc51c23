"""Writers: feature table, result lines, exports, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from authorlens import schemas
from authorlens.operators.scoring import batch_summary, percent
from authorlens.sources.readers import shown_id

# Header of the result export.
EXPORT_COLUMNS = [("id", "ID"), ("file", "Datoteka"), ("detected_language", "Jezik"),
                  ("ai_probability", "AI vjerojatnost (%)"), ("verdict", "Zakljucak")]


def write_features(features: DataFrame, path: str, form: str = "csv") -> None:
    """Feature table in contract order; failed rows are left to ``failures``."""
    good = features.filter(F.col("error").isNull()) if "error" in features.columns else features
    out = good.select(*[c for c in schemas.DATASET.fieldNames() if c in good.columns])
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def failures(features: DataFrame) -> DataFrame:
    """How many rows succeeded and failed."""
    return features.agg(F.count_if(F.col("error").isNull()).alias("succeeded"),
                        F.count_if(F.col("error").isNotNull()).alias("failed"))


def result_lines(results: DataFrame) -> DataFrame:
    """One JSON line per result, null fields kept."""
    if dict(results.dtypes).get("id") == "string":
        results = results.withColumn("id", shown_id(F.col("id")))
    return results.select(F.to_json(F.struct(F.lit("result").alias("type"), F.struct("*").alias("data")),
                                    {"ignoreNullFields": "false"}).alias("value"))


def summary_line(results: DataFrame) -> DataFrame:
    return batch_summary(results).select(
        F.to_json(F.struct(F.lit("summary").alias("type"), F.struct("*").alias("data"))).alias("value"))


def write_result_lines(results: DataFrame, path: str) -> None:
    """Result lines, then the summary line in a file of its own that sorts last."""
    result_lines(results).write.mode("overwrite").text(path)
    summary_line(results).coalesce(1).write.mode("append").text(path)


def export_rows(results: DataFrame) -> DataFrame:
    def cell(name: str) -> Column:
        if name == "ai_probability":
            return F.concat(percent(F.col(name)).cast("string"), F.lit("%"))
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in results.columns else F.lit("")

    return results.select(*[cell(n).alias(h) for n, h in EXPORT_COLUMNS])


def write_export(results: DataFrame, path: str) -> None:
    (export_rows(results).write.mode("overwrite").option("header", True).option("sep", ";")
     .option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path))


def write_predictions(pred: DataFrame, path: str) -> None:
    pred.select("y_true", F.col("p").alias("y_pred_proba"), "source").write.mode("overwrite").option(
        "header", True).csv(path)
