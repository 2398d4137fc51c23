"""Phrases against a slow greedy parse; accuracy on documents that were not learned from."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from authorlens.llm import langid
from tests.llm.odd import docs, none


def slow(sample, text):
    """Greedy phrases of each piece: longest match in the sample, else one character."""
    n = 0
    for lo in range(0, len(text), langid.PIECE):
        piece, i = text[lo:lo + langid.PIECE], 0
        while i < len(piece):
            k = 1
            while i + k < len(piece) and piece[i:i + k + 1] in sample:
                k += 1
            n, i = n + 1, i + k
    return n


def test_phrases():
    samples = {"a": "the cat sat on the mat with the hat", "b": "abracadabra alakazam abba"}
    model = langid.fit(samples)
    texts = ["", "the hat", "zzz", "abracat on mat", "the cat alakazam " * 40, "q" + "the " * 31 + "cat"]
    got = langid.phrases(model, texts)
    assert got.tolist() == [[slow(samples[k], t) for k in "ab"] for t in texts]


def test_odd_rows(spark):
    got = {(r.doc_id, r.lang_pred) for r in langid.digest(docs(spark)).collect()}
    assert {(1, "und"), (2, "und"), (5, "und")} <= got
    assert langid.digest(none(spark)).count() == 0
    assert {r.lang_pred for r in langid.digest(docs(spark).withColumn("lang", F.col("spans"))).collect()} <= {"und", "x"}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.digest(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
