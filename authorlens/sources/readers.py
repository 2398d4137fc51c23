"""Readers: code files, submissions, feature tables, result streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from authorlens import schemas
from authorlens.operators.corpus import usable_rows

# Extensions the upload accepts.
NO_ID = "nepoznat"
ACCEPTED = [".py", ".js", ".java", ".cpp", ".ts", ".go", ".rs", ".rb", ".c", ".h"]


def id_of_file(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]+\z", "")


def is_accepted(name: Column) -> Column:
    return F.rlike(F.lower(name), F.lit(r"(?:" + "|".join(e.replace(".", r"\.") for e in ACCEPTED) + r")\z"))


def read_code_files(spark: SparkSession, path: str, accepted_only: bool = True) -> DataFrame:
    """One row per file ``(id, file, code)``; files that vanish meanwhile are skipped."""
    raw = spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True, recursiveFileLookup=True)
    out = raw.select(F.col("_metadata.file_name").alias("file"), F.coalesce("value", F.lit("")).alias("code"))
    if accepted_only:
        out = out.filter(is_accepted(F.col("file")))
    return out.select(id_of_file(F.col("file")).alias("id"), "file", "code")


def normalise_submissions(df: DataFrame) -> DataFrame:
    """``filename`` falls back to ``file``; a missing id becomes a key of the row's own content.

    The key keeps rows without id apart in joins; ``shown_id`` gives the default id back.
    """
    name = F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.col("file"))
    own = F.concat(F.lit(f"{NO_ID}#"), F.md5(F.to_json(F.struct(*[c for c in df.columns if c != "id"])).cast("binary")))
    return df.withColumn("id", F.coalesce("id", own)).withColumn("filename", name)


def shown_id(id_: Column) -> Column:
    """The id as results show it."""
    return F.when(F.rlike(id_, F.lit(rf"\A{NO_ID}#[0-9a-f]{{32}}\z")), F.lit(NO_ID)).otherwise(id_)


def read_submissions(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """JSON submissions, one object per line (or one array per file with ``multiline``)."""
    rows = spark.read.schema(schemas.SUBMISSION).option("multiLine", multiline).json(path)
    return normalise_submissions(rows)


def stream_submissions(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.SUBMISSION)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return normalise_submissions(reader.json(path))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSV with a header; a row with a malformed number is left out whole."""
    raw = spark.read.option("header", True).schema(T.StructType(
        [T.StructField(f.name, T.StringType()) for f in schemas.DATASET.fields])).option("enforceSchema", False).csv(path)
    return usable_rows(raw)


def read_results(spark: SparkSession, path: str, data_schema: T.StructType | None = None) -> DataFrame:
    """Result lines as ``(type, data, raw, place)``; lines that are no JSON objects are left out.

    ``place`` orders the lines as they stand: by file name, then within the file.
    """
    kind = T.StructType([T.StructField("type", T.StringType()),
                         T.StructField("data", data_schema or T.StringType())])
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    parsed = lines.filter(F.trim("value") != "").select(
        F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("m"), F.col("value").alias("raw"), "place")
    return parsed.filter(F.col("m.type").isin("result", "summary")).select("m.type", "m.data", "raw", "place")


def result_totals(messages: DataFrame) -> DataFrame:
    """Number of results and the last summary text, null when the stream broke off."""
    return messages.agg(F.count_if(F.col("type") == "result").alias("results"),
                        F.max_by(F.get_json_object("raw", "$.data"), F.when(F.col("type") == "summary", F.col("place"))).alias("summary"))
