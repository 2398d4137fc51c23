"""Columns and types of every query, as the contracts name them."""

from pathlib import Path

import pytest

from authorlens.llm.queries import QUERIES

CONTRACT = {
    "op1_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_tokens": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op7_metricjoin": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_repeats": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op12_clusters": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
@pytest.mark.parametrize("name", CONTRACT)
def test_schema(spark, name):
    got = [f"{c} {t}" for c, t in QUERIES[name](spark, "/root/testdata/sf0.001").dtypes]
    assert got[:len(CONTRACT[name].split(", "))] == CONTRACT[name].split(", ")


def test_every_query_is_held():
    assert set(QUERIES) == {*CONTRACT, "op4_decontam"}
