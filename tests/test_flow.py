"""Sources, sinks, the analysis plan and its stream."""

import json

import pytest
from pyspark.sql import functions as F

from authorlens import schemas
from authorlens.operators import perplexity, scoring, training
from authorlens.plans.analysis import analyze
from authorlens.sources import readers, sinks
from authorlens.streaming import results as stream
from tests.snippets import JAVA, PYTHON
from tests.test_learning import samples


@pytest.fixture(scope="module")
def model(spark):
    return training.train(samples(spark), training.ForestSettings(trees=3, depth=3, calibration_folds=2),
                          names=schemas.MODEL_FEATURES[:8], validate=False)


def submissions(spark):
    return spark.createDataFrame(
        [("p", PYTHON, None, "a.py"), ("j", JAVA, "java", None), ("s", "x = 1", None, None), ("e", "  ", None, None), ("u", PYTHON, "cobol", None)],
        "id string, code string, language string, filename string")


def test_analyze(spark, model):
    got = {r.id: r for r in analyze(submissions(spark), model).collect()}
    assert got["p"].detected_language == "python" and got["j"].detected_language == "java"
    for i in "pj":
        r = got[i]
        assert r.error is None and 0 <= r.ai_probability <= 1 and len(r.top_features) == 5 and r.explanations and r.line_annotations
        assert r.verdict in scoring.VERDICTS and r.all_features.total_lines > 5
    assert got["s"].verdict == scoring.TOO_SHORT_VERDICT and got["s"].ai_probability is None and got["s"].top_features == []
    assert got["e"].error == scoring.EMPTY_ERROR and got["u"].error.startswith("Jezik 'cobol'")
    assert got["u"].ai_probability is None and got["u"].explanations is None


def test_without_model(spark):
    got = {r.id: r for r in analyze(submissions(spark), None).collect()}
    assert got["p"].verdict == scoring.NO_MODEL_VERDICT and got["p"].ai_probability is None
    assert got["s"].verdict == scoring.NO_MODEL_VERDICT and got["s"].error == scoring.NO_MODEL_ERROR
    assert got["e"].error == scoring.EMPTY_ERROR and got["u"].error.startswith("Jezik 'cobol'") and got["u"].verdict is None


def test_lines_are_marked_where_no_score_is(spark, model):
    note = "# four words of comment"
    df = spark.createDataFrame([("s", note, "python"), ("u", note, "cobol"), ("e", "", "python")], "id string, code string, language string")
    for m in (None, model):
        got = {r.id: r for r in analyze(df, m).collect()}
        assert [(a.line, a.tone) for a in got["s"].line_annotations] == [(1, "amber")] and got["s"].detected_language is None
        assert got["u"].line_annotations is None and got["u"].error.startswith("Jezik 'cobol'")
        assert got["e"].line_annotations is None and got["e"].error == scoring.EMPTY_ERROR


def test_submissions_without_id_stay_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"code": "x = 1"}\n{"code": "y = 2"}\n{"id": "k", "code": "z"}\n')
    got = readers.read_submissions(spark, str(tmp_path))
    ids = [r.id for r in got.collect()]
    assert len(set(ids)) == 3 and "k" in ids
    assert sorted(r.s for r in got.select(readers.shown_id(F.col("id")).alias("s")).collect()) == ["k", "nepoznat", "nepoznat"]
    assert scoring.attach_source(got.select("id"), got).count() == 3


def test_last_summary_counts(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("".join(json.dumps({"type": "summary", "data": {"total": n}}) + "\n" for n in (9, 11, 10)))
    assert json.loads(readers.result_totals(readers.read_results(spark, str(tmp_path))).first().summary)["total"] == 10


def test_plan_is_narrow(spark, model):
    plan = analyze(submissions(spark), None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_stream_equals_batch(spark, model, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [r.asDict() for r in submissions(spark).collect()]
    for i in range(3):
        with open(src / f"{i}.json", "w") as f:
            f.writelines(json.dumps({**r, "id": f"{r['id']}{i}"}) + "\n" for r in rows)
        with open(src / f"{i}.json", "a") as f:
            f.write("{broken\n")
    stream.start_scoring(spark, str(src), str(out), str(tmp_path / "ck"), model).awaitTermination()
    batch = scoring.batch_summary(analyze(readers.read_submissions(spark, str(src)), model)).first()
    assert stream.summary(spark, str(out)).first() == batch
    stream.start_summary(spark, str(out), "totals", str(tmp_path / "ck2")).awaitTermination()
    assert spark.table("totals").first() == batch
    errors = spark.read.parquet(str(out / "errors"))
    assert errors.filter("id like 'e%'").count() == 3
    lines = readers.read_results(spark, str(out / "lines"))
    assert readers.result_totals(lines).first().results == batch.total


def test_stream_with_a_stored_language_model(spark, model, tmp_path):
    """Every streamed row is the batch row, before and after a restart; half the pairs are new to the model."""
    src, out, stored = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "bigrams")
    src.mkdir()
    corpus = spark.createDataFrame([("a", PYTHON), ("b", "x y z\n" * 9)], "id string, code string")
    perplexity.bigram_model(corpus).save(stored)
    rows = [{**r.asDict(), "label": 1} for r in submissions(spark).collect()]
    for part in ("0", "1"):  # a second run of the stream goes on from its checkpoint
        for n in "ab":
            (src / f"{part}{n}.json").write_text("".join(json.dumps({**r, "id": f"{r['id']}{part}"}) + "\n" for r in rows))  # ids repeat
        stream.start_scoring(spark, str(src), out, str(tmp_path / "ck"), model, language_model=stored, files_per_trigger=1).awaitTermination()
        batch = perplexity.with_row_key(readers.read_submissions(spark, str(src)))
        scored = perplexity.row_perplexity(batch, perplexity.load_model(spark, stored))
        want = analyze(batch, model, scored=scored).collect()
        got = spark.read.parquet(f"{out}/results").drop("batch").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
        values = [r.all_features.perplexity for r in got if r.all_features]
        assert values and all(v > 0 for v in values) and {r.all_features.model_available for r in got if r.all_features} == {1}


def test_unseen_pairs(spark, tmp_path):
    import math
    perplexity.bigram_model(spark.createDataFrame([(1, "a b a b a c"), (2, "")], "id int, code string")).save(str(tmp_path))
    model = perplexity.load_model(spark, str(tmp_path))
    assert model.vocabulary == 3
    df = spark.createDataFrame([(1, "a b"), (2, "a z"), (3, "z a"), (4, "a b z q"), (5, "a"), (6, "")], "id int, code string")
    got = {r.id: (r.n_pairs, r.perplexity) for r in perplexity.bigram_perplexity(df, model=model).collect()}
    seen, known, new = 3 / 6, 1 / 6, 1 / 3  # a b twice after three a; an a before something new; a new first token
    b_new = 1 / (2 + 3)
    want = {1: (1, 1 / seen), 2: (1, 1 / known), 3: (1, 1 / new), 4: (3, math.exp(-(math.log(seen) + math.log(b_new) + math.log(new)) / 3)), 5: (0, -1.0), 6: (0, -1.0)}
    assert got == {i: (n, pytest.approx(p)) for i, (n, p) in want.items()}
    nothing = perplexity.bigram_model(df.limit(0))
    assert {r.perplexity for r in perplexity.bigram_perplexity(df, model=nothing).collect()} == {1.0, -1.0}
    assert perplexity.bigram_perplexity(df.limit(0), model=model).count() == 0


def test_features_with_perplexity_move_no_texts(spark, tmp_path):
    from authorlens.catalog import text_queries
    spark.createDataFrame([(1, PYTHON, "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = text_queries.feature_table(spark, str(tmp_path))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [node for node in plan.split("\n\n") if "Exchange" in node.split("\n")[0]]
    assert moved and not any("code#" in node or "text#" in node for node in moved)


def test_code_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.b.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "sub" / "c.JAVA").write_text("class C {}")
    (tmp_path / "n.txt").write_text("no")
    got = {r.file: (r.id, r.code) for r in readers.read_code_files(spark, str(tmp_path)).collect()}
    assert got == {"a.b.py": ("a.b", "x = 1\ny = 2\n"), "c.JAVA": ("c", "class C {}")}


def test_result_lines_and_export(spark, tmp_path):
    df = spark.createDataFrame([("a", "a.py", "python", 0.715, "Moguće AI"), ("b;c", "b.py", None, None, None)],
                               "id string, file string, detected_language string, ai_probability double, verdict string")
    path = str(tmp_path / "lines")
    sinks.write_result_lines(df, path)
    with open(tmp_path / "lines" / "part-broken.txt", "w") as f:
        f.write("{broken\n\n")
    t = readers.result_totals(readers.read_results(spark, path)).first()
    assert t.results == 2 and json.loads(t.summary)["total"] == 2
    sinks.write_export(df, str(tmp_path / "csv"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert "ID;Datoteka;Jezik;AI vjerojatnost (%);Zakljucak\r\n" in text and 'a;a.py;python;72%;Moguće AI\r\n' in text
    assert '"b;c";b.py;;0%;\r\n' in text


def test_feature_csv_roundtrip(spark, tmp_path):
    from authorlens.operators.features import extract_features
    df = submissions(spark).withColumns({"label": F.lit(1), "source": F.lit("x")})
    feats = extract_features(df, keep=["id", "label", "source"])
    assert sinks.failures(feats).first() == (4, 1)
    sinks.write_features(feats, str(tmp_path / "f"))
    back = readers.read_features(spark, str(tmp_path / "f"))
    assert back.count() == 4
    a = sorted(round(r.token_entropy, 6) for r in feats.filter("error is null").collect())
    assert a == sorted(round(r.token_entropy, 6) for r in back.collect())


def test_perplexity_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a b a b"), (1, "a b c"), (1, "x y x y z"), (1, "a b c"), (None, "x"), (2, "")]
    df = spark.createDataFrame(rows, "id int, code string")
    alone = perplexity.bigram_perplexity(spark.createDataFrame([(i, c) for i, (_, c) in enumerate(rows)], "id int, code string")).collect()
    want = sorted((str(rows[r.id][0]), rows[r.id][1], round(r.perplexity, 9)) for r in alone)
    got = perplexity.with_perplexity(df)
    assert got.columns == ["id", "code", "_ppl"]
    assert sorted((str(r.id), r.code, round(r._ppl, 9)) for r in got.collect()) == want

    from authorlens.catalog import result_queries, text_queries
    code = "def f(x):\n    y = x + 1\n    z = y * 2\n    w = z - y\n    return w\n"
    table = [(i, code + f"v{n} = {n}\n", "s", "en") for n, i in enumerate([None, None, 7, 7, 7, *range(20, 60)])]
    spark.createDataFrame(table, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in [7, *range(20, 60)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (text_queries.feature_table, result_queries.analysis):
        out = [r.id for r in query(spark, str(tmp_path)).collect()]
        assert len(out) == len(table) and out.count(None) == 2 and out.count(7) == 3


def test_perplexity(spark):
    import math
    from collections import Counter
    codes = ["a b a b", "a b c", "x", ""]
    df = spark.createDataFrame(list(enumerate(codes)), "id int, code string")
    pairs = Counter(p for c in codes for p in zip(c.split(), c.split()[1:]))
    first = Counter()
    for (a, _), n in pairs.items():
        first[a] += n
    v = len({t for c in codes for t in c.split()})
    got = {r.id: r.perplexity for r in perplexity.bigram_perplexity(df).collect()}
    for i, c in enumerate(codes):
        ps = list(zip(c.split(), c.split()[1:]))
        want = math.exp(-sum(math.log((pairs[p] + 1) / (first[p[0]] + v)) for p in ps) / len(ps)) if ps else -1.0
        assert got[i] == pytest.approx(want)
