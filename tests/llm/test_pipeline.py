"""The stages one after the other, each against a plain version, and rows of every odd kind."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from authorlens.llm import simhash
from tests.llm.odd import docs, none
from tests.llm.test_simhash import roots_of, slow_print

rng = random.Random(8)
WORDS = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(2_000)]


def near_copies():
    texts = []
    for _ in range(10):
        words = rng.choices(WORDS, k=rng.choice((8, 60, 400)))
        for _ in range(8):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.choice((0, 0, 1))):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
    return texts + ["", None, " \n", "  "]


def stays(rows):
    """One row of each component, by all pairs of fingerprints bit by bit: the smallest id, a null one last."""
    prints = [slow_print(t) for _, t in rows]
    roots = roots_of(range(len(rows)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    return [min((rows[i] for i in roots if roots[i] == r), key=lambda x: (x[0] is None, x[0] or 0))[0] for r in set(roots.values())]


@pytest.mark.parametrize("hot", [64, 1])
def test_one_of_each(spark, hot):
    texts = near_copies()
    ids = rng.sample(range(1_000), len(texts))
    rows = list(zip(ids, texts))
    kept = simhash.one_of_each(docs(spark, [(i, t, "en", "s", 1, None, None) for i, t in rows]), hot=hot).collect()
    assert sorted(r.doc_id for r in kept) == sorted(stays(rows)) and {(r.doc_id, r.text) for r in kept} <= set(rows)


def test_rows_without_or_with_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "p q r s t u"), (7, "p q r s t u"), (7, "k l m n o z y x"), (None, "k l m n o z y x"),
            (None, None), (None, "")]
    kept = simhash.one_of_each(docs(spark, [(i, t, "en", "s", 1, str(n), n) for n, (i, t) in enumerate(rows)])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept if r.text), key=str) == [(7, "k l m n o z y x"), (7, "p q r s t u"), (None, "a b c d e f")]
    assert len(kept) == 4


def test_odd_rows(spark):
    kept = simhash.one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    # 1, 2 and 5 are blank; 3 twice and the null id are equal
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6]
    assert simhash.one_of_each(none(spark)).count() == 0


def run_on(spark, folder, rows):
    import corpus_pipeline
    rows.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "passage of the benchmark " * 9), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_pipeline_on_odd_rows(spark, tmp_path):
    got = run_on(spark, tmp_path, docs(spark).unionByName(docs(spark, [(9, "passage of the benchmark " * 9, "en", "s", 1, None, None)])))
    pieces = got.collect()
    assert {r.doc_id for r in pieces} == {1, 3, 4, 6} and sum(r.length for r in pieces if r.doc_id == 1) == 1


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert run_on(spark, tmp_path, none(spark)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    start = spark.read.parquet(f"{sf}/documents.parquet")
    d, before = start, start.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, d, sf).checkpoint()
        assert after.columns == start.columns and after.schema.simpleString() == start.schema.simpleString()
        assert 0 < after.count() <= before
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in after.collect()) == sorted(stays([(r.doc_id, r.text) for r in d.collect()]))
        d, before = after, after.count()
    assert all(r.n_chars == len(r.text) for r in d.collect())
    direct = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    whole = corpus_pipeline.run(spark, sf)
    narrow = lambda f: sorted(map(tuple, f.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert narrow(direct) == narrow(whole) and {r.doc_id for r in whole.select("doc_id").distinct().collect()} == {r.doc_id for r in d.collect()}
