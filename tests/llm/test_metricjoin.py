"""Links and components against all pairs, in one block and in many."""

import numpy as np
import pytest

from authorlens.llm import metricjoin


def brute(rows, cosine=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    lab, n = list(range(len(good))), [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                n[a], n[b] = n[a] + 1, n[b] + 1
                p, q = lab[a], lab[b]
                lab = [min(p, q) if k in (p, q) else k for k in lab]
    least = {}
    for (i, _), k in zip(good, lab):
        least[k] = min(least.get(k, i), i)
    out = sorted((i, c, least[k], i == least[k]) for (i, _), c, k in zip(good, n, lab))
    return sorted(out + [(i, 0, i, True) for i, v in rows if i not in {g for g, _ in good}])


@pytest.mark.parametrize("block", [4096, 7])
def test_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    rows = [[i, rng.normal(size=8)] for i in range(60)]
    for i in range(60, 160):
        rows.append([i, rows[rng.integers(0, 12)][1] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.4])])
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(200 + i, rows[3][1]) for i in range(9)] + [(300, [2 * x for x in rows[3][1]])]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (404, []), (405, [float("inf")] + [1.0] * 7), (406, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted(map(tuple, metricjoin.near_vectors(frame, block=block).collect()))
    assert got == brute(rows)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metricjoin.near_vectors(frame).count() == 0
