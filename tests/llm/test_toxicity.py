"""The machine against all pairs of terms, what interactions add, and held-out documents."""

from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest

from authorlens.llm import toxicity
from authorlens.llm.tables import held_out
from tests.llm.odd import docs, none


def test_pairs_cost_is_exact():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.3, {}, rng.normal(size=9), rng.normal(size=(9, 4)))
    rows = [(np.array(r, np.uint32), n) for r, n in (([], 0), ([3], 5), ([0, 4, 8], 3), (list(range(9)), 40))]
    want = [0.3 + sum(m.weights[i] for i in r) + sum(m.factors[i] @ m.factors[j] for i in r for j in r if i < j) / max(1, n) for r, n in rows]
    assert np.allclose(toxicity.raw_scores(m, rows), want)


def test_pairs_of_common_words_are_learned(spark):
    """Every document has an insult or not, and names a group or not, as often in both classes: only which go together tells."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(5000):
        insult, group = rng.random(2) < 0.5
        noise = [f"w{k}" for k in rng.choice(400, 20, replace=False)]
        rows.append((i, " ".join(rng.permutation(noise + ["fool" if insult else "friend", "them" if group else "us"])), int(insult == group)))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    machine = toxicity.learn(d, labels)
    linear = replace(machine, factors=np.zeros_like(machine.factors))
    truth = {i: t for i, _, t in rows}
    right = [np.mean([r.predicted == truth[r.doc_id] for r in toxicity.score(d, m).where(held_out()).collect()]) for m in (machine, linear)]
    assert right[0] >= 0.95 and right[1] <= 0.6, right
    assert len(machine.places) < 100  # vectors that no pair needs have left


def test_a_smaller_sample_moves_no_scores(spark, monkeypatch):
    """Labels that no term tells surely: what the machine believes must not hang on how many clean rows were drawn."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        toxic = int(rng.random() < 0.1)
        some = rng.choice(200, 12, replace=False)
        rows.append((i, " ".join(f"w{k}" for k in some) + (" bad" if rng.random() < (0.7 if toxic else 0.15) else ""), toxic))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    clean = {i for i, _, t in rows if not t}
    seen = []
    for size in (4000, 300):
        monkeypatch.setattr(toxicity, "SAMPLE_ROWS", size)
        got = toxicity.digest(d, labels).collect()
        seen.append((np.mean([r.score for r in got]), sum(r.predicted for r in got if r.doc_id in clean) / len(clean)))
    assert abs(seen[0][0] - seen[1][0]) < 0.04 and abs(seen[0][1] - seen[1][1]) < 0.04, seen


def test_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 1, 1), (6, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.digest(docs(spark), some).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.digest(none(spark), labels).count() == 0
    machine = toxicity.learn(docs(spark), labels.limit(0))
    assert toxicity.keep_clean(docs(spark), machine).count() == 8


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_held_out_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.digest(d, labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in got if r.toxic]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in got if not r.toxic) <= 0.005 * len(got)
