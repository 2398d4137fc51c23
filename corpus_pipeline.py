"""A training corpus from documents: five stages, each one of the operators of ``authorlens.llm``.

Every stage takes the columns of documents, in any order and with others beside them, which ``run`` leaves out.  A null text is
empty to all of them and stays null if its document stays; ids may be null or repeated; an empty table gives one.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from authorlens.llm import decontam, packing, secrets, simhash, toxicity
from authorlens.llm.tables import documents, table
from authorlens.session import checkpoint_dir


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go; it learns from labels of documents that are not held out.

    Rows are judged one by one, repeated ones alike; without labels of both classes none goes unless all labels are toxic.
    """
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose SimHash fingerprints of three-word shingles link at two bits or fewer, the document of smallest id stays.

    So of all null, empty and blank texts one stays, and of repeated rows one.
    """
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go; null and empty texts and items hold and are none."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows, and stays null where it is."""
    out = secrets.redacted(docs.withColumn("chars__", F.length("text")))
    return out.withColumn("n_chars", F.col("n_chars") + F.coalesce(F.length("text") - F.col("chars__"), F.lit(0))).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences; a null or empty text is its end mark alone."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", sequences),
]

#: Fitted, fuzzy and tokenizing stages have no SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is a table in the shared folder, so a lost executor costs one stage's work at most."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid4()}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
