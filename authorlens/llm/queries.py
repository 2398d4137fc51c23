"""One query per operator, over whole tables, with the columns its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from authorlens.llm import (clusters, decontam, langid, metricjoin, packing, pii, repeats, resampling, secrets, shards, simhash, tokens,
                            toxicity)
from authorlens.llm.tables import documents, table


def op1_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(documents(spark, sf, "doc_id", "text"))


def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(documents(spark, sf, "doc_id", "text"))


def op3_langid(spark: SparkSession, sf: str) -> DataFrame:
    return langid.digest(documents(spark, sf, "doc_id", "text", "lang"))


def op4_decontam(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.found_leaks(documents(spark, sf, "doc_id", "text"), table(spark, sf, "benchmark"))


def op5_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.sharded(documents(spark, sf))


def op6_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.counts(documents(spark, sf, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op7_metricjoin(spark: SparkSession, sf: str) -> DataFrame:
    return metricjoin.near_vectors(table(spark, sf, "embeddings"))


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(documents(spark, sf, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf, "doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.digest(documents(spark, sf, "doc_id", "text"), table(spark, sf, "labels"))


def op11_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.digest(documents(spark, sf, "doc_id", "text"))


def op12_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.clustered(table(spark, sf, "embeddings"))


def op13_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf, "doc_id", "text"), table(spark, sf, "benchmark"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_pii": op2_pii,
    "op3_langid": op3_langid,
    "op4_decontam": op4_decontam,
    "op5_shards": op5_shards,
    "op6_tokens": op6_tokens,
    "op7_metricjoin": op7_metricjoin,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_repeats": op11_repeats,
    "op12_clusters": op12_clusters,
    "op13_resampling": op13_resampling,
}

ORACLE = {
    "op2_pii": pii.oracle(),
    "op11_repeats": repeats.oracle(),
    "op12_clusters": clusters.oracle(),
    "op13_resampling": resampling.oracle(),
}
