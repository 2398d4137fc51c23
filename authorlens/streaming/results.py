"""Result stream: each submission is judged as it arrives, the summary follows the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from authorlens.operators import scoring
from authorlens.operators.perplexity import load_model, row_perplexity, with_row_key
from authorlens.operators.training import CalibratedForest
from authorlens.plans.analysis import analyze
from authorlens.sources.readers import stream_submissions
from authorlens.sources.sinks import result_lines


def start_scoring(spark: SparkSession, source: str, sink: str, checkpoint: str, model: CalibratedForest | None,
                  threshold: float = scoring.DEFAULT_THRESHOLD, files_per_trigger: int | None = None,
                  once: bool = True, language_model: str | None = None) -> StreamingQuery:
    """Judges new submission files and appends result rows under ``sink/results``.

    Rows with an error stay in the results and are also kept under ``sink/errors``.  Each
    micro-batch owns one folder and overwrites it, so a repeated batch leaves no double rows.

    ``language_model`` is the folder of a stored ``BigramModel``; its perplexity then joins the rows
    of each micro-batch as it does in a batch, and a restarted stream goes on with the same model.
    """
    stream = stream_submissions(spark, source, files_per_trigger)
    judged = stream if language_model else analyze(stream, model, threshold)
    bigrams = load_model(spark, language_model) if language_model else None

    def with_perplexity(batch: DataFrame) -> DataFrame:
        rows = with_row_key(batch)
        return analyze(rows, model, threshold, scored=row_perplexity(rows, bigrams))

    def write(batch: DataFrame, number: int) -> None:
        batch = (with_perplexity(batch) if bigrams else batch).persist()
        try:
            batch.write.mode("overwrite").parquet(f"{sink}/results/batch={number}")
            result_lines(batch).write.mode("overwrite").text(f"{sink}/lines/batch={number}")
            batch.filter(F.col("error").isNotNull()).select("id", "error").write.mode("overwrite").parquet(
                f"{sink}/errors/batch={number}")
        finally:
            batch.unpersist()

    writer = judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def summary(spark: SparkSession, sink: str) -> DataFrame:
    """Totals over everything judged so far."""
    return scoring.batch_summary(spark.read.parquet(f"{sink}/results"))


def start_summary(spark: SparkSession, sink: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Running totals as a streaming aggregate of fixed size; the latest row is in the memory table."""
    schema = spark.read.parquet(f"{sink}/results").schema
    stream = spark.readStream.schema(schema).parquet(f"{sink}/results")
    writer = (scoring.batch_summary(stream).writeStream.outputMode("complete").format("memory").queryName(table)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()
