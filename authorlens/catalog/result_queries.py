"""Queries over probabilities, samples and predictions."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F, types as T

from authorlens import schemas
from authorlens.catalog import inputs as I
from authorlens.catalog.code_texts import code_of
from authorlens.operators import corpus, evaluation, ranking, scoring, training
from authorlens.operators.features import extract_features
from authorlens.operators.perplexity import ROW, attach_perplexity, row_perplexity
from authorlens.plans.analysis import analyze
from authorlens.session import checkpoint_dir, cut_lineage
from authorlens.sources.readers import read_results, result_totals
from authorlens.sources.sinks import export_rows, result_lines, write_result_lines

ROUND = 6
SMALL_FOREST = training.ForestSettings(trees=8, depth=6)  # the default has 300 trees of depth 30


def _r(df, *names):
    return df.withColumns({n: F.round(n, ROUND) for n in names})


def _results(spark, sf):
    """Documents with a stand-in probability; some have none, as rejected rows do."""
    d = I.documents(spark, sf)
    return d.withColumn("ai_probability", I.probability(F.col("code"))).withColumn(
        "file", F.concat(F.col("id").cast("string"), F.lit(".py")))


# ------------------------------------------------------------------ results

def verdicts(spark, sf):
    d = _results(spark, sf)
    p = F.col("ai_probability")
    return d.select("id", F.round(p, 4).alias("ai_probability"), scoring.verdict(p).alias("verdict"),
                    scoring.verdict(p, 0.8).alias("verdict_at_80"))


def risk_summary(spark, sf):
    return scoring.batch_summary(_results(spark, sf))


def risk_summary_by_source(spark, sf):
    return scoring.batch_summary(_results(spark, sf), ["source"])


def display_labels(spark, sf):
    p = F.col("ai_probability")
    return _results(spark, sf).select("id", scoring.percent(p).alias("percent"), scoring.display_label(p).alias("label"),
                                      scoring.risk_bucket(p).alias("bucket"))


def sorted_results(spark, sf):
    return scoring.sort_results(_results(spark, sf)).select("id", F.round("ai_probability", ROUND).alias("ai_probability"))


def results_with_source(spark, sf):
    d = I.documents(spark, sf)
    r = _results(spark, sf).select("id", F.round("ai_probability", 4).alias("ai_probability"))
    return scoring.attach_source(r, d.withColumn("file", F.col("source"))).select(
        "id", "ai_probability", "file", F.length("code").cast("bigint").alias("n_chars"))


def export_table(spark, sf):
    d = _results(spark, sf).withColumn("verdict", scoring.verdict(F.col("ai_probability"))).withColumn(
        "detected_language", F.col("lang"))
    out = export_rows(d)
    return out.toDF("id", "file", "language", "percent", "verdict")


def result_messages(spark, sf):
    """Result lines written as JSON and read back."""
    d = _results(spark, sf).select("id", "ai_probability", "source")
    kind = T.StructType([T.StructField("type", T.StringType()), T.StructField("data", d.schema)])
    back = result_lines(d).select(F.from_json("value", kind).alias("m"))
    return back.select("m.type", "m.data.id", F.round("m.data.ai_probability", ROUND).alias("ai_probability"), "m.data.source")


def result_stream_totals(spark, sf):
    """Result lines and their summary line written as files and read back, as a screen does when a stream has ended."""
    path = f"{checkpoint_dir(spark)}/lines-{uuid4()}"
    write_result_lines(_results(spark, sf).select("id", "ai_probability", "source"), path)
    totals = result_totals(read_results(spark, path))
    said = lambda name, kind: F.get_json_object("summary", f"$.{name}").cast(kind).alias(name)
    return totals.select("results", *[said(n, "bigint") for n in ("total", "high_risk", "medium_risk", "low_risk")], said("avg_ai_probability", "double"))


def top_features(spark, sf):
    """Five heaviest features with their values; the weights are a fixed function of the name."""
    from authorlens.catalog.text_queries import _judged
    d = _judged(spark, sf)
    names = ["comment_ratio", "avg_line_length", "max_line_length", "token_entropy", "empty_line_ratio",
             "trailing_whitespace_ratio", "total_lines"]
    heavy = d.agg(*[F.count(F.lit(1)).alias(n) for n in names])
    weights = heavy.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("name"), (F.lit(float(len(n))) / 100.0).alias("importance")) for n in names])))
    out = scoring.top_features(d, weights)
    return out.select("id", F.posexplode_outer("top_features").alias("rank", "f")).select(
        "id", (F.col("rank") + 1).cast("bigint").alias("rank"), "f.name", "f.value", "f.importance")


# ------------------------------------------------------------------ corpus

def _raws(spark, sf):
    """The tables in the column layouts of the four raw corpora."""
    docs = I.samples(spark, sf).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 5 != 0, F.col("code")).alias("code"),
        F.col("code").alias("source_code"), F.when(F.col("id") % 3 != 0, F.when(F.col("label") == 0, F.lit("Human_written"))
                                                   .otherwise(F.lit("codellama"))).alias("label"),
        F.col("label").alias("is_generated"))
    talk = I.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("solution"),
        (F.col("role") == "assistant").alias("is_generated"))
    bench = I.table(spark, sf, "benchmark")
    return {"AIGCodeSet": docs, "ai-code-detection": talk,
            "MBPP": bench.select(F.concat(F.lit("m"), F.col("item_id")).alias("id"), F.col("text").alias("code")),
            "HumanEval": I.documents(spark, sf).select(F.concat(F.lit("h"), F.col("id")).alias("id"),
                                                       F.col("code").alias("canonical_solution"))}


_RAW_SQL = f"""(
 SELECT doc_id::VARCHAR AS id, text AS code, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN quality = 1 THEN 0 ELSE 1 END ELSE 1 - quality END AS label,
        'AIGCodeSet' AS source FROM documents JOIN labels USING (doc_id)
 UNION ALL SELECT conv_id || '-' || turn, text, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END, 'ai-code-detection' FROM conversations
 UNION ALL SELECT 'm' || item_id, text, 0, 'MBPP' FROM benchmark
 UNION ALL SELECT 'h' || d.doc_id, d.text, 0, 'HumanEval' FROM documents d JOIN (SELECT id, count(*) AS k FROM {I.lines_sql(I.DOCUMENTS)} l
        GROUP BY id) c ON c.id = d.doc_id WHERE k >= 2)"""
_UNION_SQL = f"(SELECT * FROM {_RAW_SQL} u WHERE regexp_matches(code, '[^{I.WS}]'))"


def corpus_union(spark, sf):
    u = corpus.union_corpora(_raws(spark, sf), "4")
    return u.select("id", "label", "language", "source", F.length("code").cast("bigint").alias("n_chars"))


def corpus_capped(spark, sf):
    u = corpus.union_corpora(_raws(spark, sf), "3", max_samples=200)
    return u.select("id", "label", "source")


def label_normalise(spark, sf):
    raw = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" Real-"), "source"))
        .when(F.col("doc_id") % 4 == 1, F.col("quality").cast("string"))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.col("toxic").cast("string"), F.lit(".0"))).otherwise(F.col("lang")).alias("raw"),
        (F.col("quality") + 0.75).alias("as_number"), (F.col("toxic") == 1).alias("as_flag"))
    return raw.select("id", corpus.normalise_label(F.col("raw"), T.StringType()).alias("from_text"),
                      corpus.normalise_label(F.col("as_number"), T.DoubleType()).alias("from_number"),
                      corpus.normalise_label(F.col("as_flag"), T.BooleanType()).alias("from_flag"))


def source_counts(spark, sf):
    return corpus.source_counts(corpus.union_corpora(_raws(spark, sf), "4"))


def class_stats(spark, sf):
    return _r(corpus.class_stats(corpus.union_corpora(_raws(spark, sf), "4")), "human_percent", "ai_percent")


def class_counts(spark, sf):
    return corpus.class_counts(I.samples(spark, sf))


def undersample(spark, sf):
    return corpus.undersample(I.samples(spark, sf)).select("id", "label")


def stratified_split(spark, sf):
    return corpus.stratified_split(I.samples(spark, sf)).select("id", "label", "is_test")


def held_out(spark, sf):
    return corpus.test_split(I.samples(spark, sf)).select("id", "label")


def folds(spark, sf):
    return corpus.folds(I.samples(spark, sf), 5).select("id", "label", F.col("fold").cast("bigint").alias("fold"))


def class_weights(spark, sf):
    return _r(corpus.class_weights(I.samples(spark, sf)), "weight")


def standardise(spark, sf):
    s = corpus.stratified_split(I.samples(spark, sf)).select(
        "id", "is_test", F.length("code").cast("double").alias("a"), F.lit(3.0).alias("b"))
    stats = corpus.scaler(s.filter(~F.col("is_test")), ["a", "b"])
    return _r(corpus.standardise(s, stats, ["a", "b"]), "a", "b").select("id", "a", "b")


_HASH = "md5(id || '#42')"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH}, id) AS rk, count(*) OVER (PARTITION BY label) AS np FROM ({I.SAMPLES}) s)"
_UNDER = (f"(SELECT id, label, code FROM {_RANKED} r WHERE label <> 0 OR rk <= 3 * (SELECT count(*) FROM ({I.SAMPLES}) s WHERE label = 1))")


# ------------------------------------------------------------------ evaluation

def confusion(spark, sf):
    return evaluation.confusion(I.predictions(spark, sf))


def confusion_by_source(spark, sf):
    return evaluation.confusion(I.predictions(spark, sf), ["source"])


def class_report(spark, sf):
    return _r(evaluation.class_report(I.predictions(spark, sf)), "precision", "recall", "f1")


def auc_roc(spark, sf):
    return _r(evaluation.auc_roc(I.predictions(spark, sf)), "auc_roc")


def auc_by_source(spark, sf):
    return _r(evaluation.auc_roc(I.predictions(spark, sf), by="source"), "auc_roc")


def average_precision_by_source(spark, sf):
    return _r(evaluation.average_precision(I.predictions(spark, sf), by="source"), "average_precision")


def average_precision(spark, sf):
    return _r(evaluation.average_precision(I.predictions(spark, sf)), "average_precision")


def pr_curve(spark, sf):
    return _r(evaluation.pr_curve(I.predictions(spark, sf)), "threshold", "precision", "recall")


def threshold_search(spark, sf):
    p = I.predictions(spark, sf)
    a = evaluation.threshold_search(p, min_precision=0.14, min_recall=0.3).withColumn("variant", F.lit("strict"))
    b = evaluation.threshold_search(p, strict=False, min_precision=0.14, min_recall=0.3).withColumn("variant", F.lit("flipped"))
    return _r(a.unionByName(b), "optimal_threshold", "saved_threshold")


def precision_recall_at_k(spark, sf):
    return _r(evaluation.precision_recall_at_k(I.predictions(spark, sf)), "threshold", "precision", "recall")


def score_rank(spark, sf):
    return ranking.score_rank(I.predictions(spark, sf)).select("id", "rank", "positives")


_CURVE = (f"(SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM "
          f"(SELECT p, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true <> 1) AS neg FROM ({I.PREDICTIONS}) x "
          f"GROUP BY p) y WINDOW w AS (ORDER BY p DESC))")


def _threshold_sql(p: str, name: str) -> str:
    return (f"SELECT '{name}' AS variant, round(t, 6) AS optimal_threshold, round(1 - t, 6) AS saved_threshold FROM (SELECT coalesce(min(p), 0.5) AS t FROM "
            f"(SELECT p, sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w) AS pr, sum(pos) OVER w / sum(pos) OVER () AS rc FROM (SELECT {p} AS p, "
            f"count(*) FILTER (WHERE y_true = 0)::DOUBLE AS pos, count(*) FILTER (WHERE y_true <> 0)::DOUBLE AS neg FROM ({I.PREDICTIONS}) x GROUP BY 1) y "
            f"WINDOW w AS (ORDER BY p DESC)) z WHERE pr >= 0.14 AND rc >= 0.3) v")


_CM = (f"(SELECT count(*) FILTER (WHERE p <= 0.5 AND y_true <> 1)::DOUBLE AS tn, count(*) FILTER (WHERE p > 0.5 AND y_true <> 1)::DOUBLE AS fp, "
       f"count(*) FILTER (WHERE p <= 0.5 AND y_true = 1)::DOUBLE AS fn, count(*) FILTER (WHERE p > 0.5 AND y_true = 1)::DOUBLE AS tp FROM ({I.PREDICTIONS}) x)")


# ------------------------------------------------------------------ learning

def analysis(spark, sf):
    """The whole analysis of every document: real features with perplexity, a model fitted here, reasons and marked lines."""
    d = I.documents(spark, sf, busy=True, placed=True)
    scored = cut_lineage(row_perplexity(d))
    labelled = d.join(I.labels(spark, sf), "id").withColumn("language", F.lit("python"))
    data = attach_perplexity(extract_features(labelled, keep=["id", "label", "source", ROW]), scored)
    data = cut_lineage(data.select("id", "label", "source", "detected_language", *schemas.FEATURES))
    model = training.train(data, SMALL_FOREST, validate=False)
    out = analyze(d, model, model.threshold, scored=scored)
    return out.select("id", "ai_probability", "verdict", "detected_language", "error", F.get("top_features", F.lit(0))["name"].alias("first_feature"),
                      F.round(F.col("all_features.perplexity"), ROUND).alias("perplexity"), F.size("explanations").alias("n_reasons"),
                      F.size("line_annotations").alias("n_lines"))


def reasons(spark, sf):
    """Every reason with its text, over all forty features of every document as code, perplexity among them."""
    d = I.documents(spark, sf, busy=True, placed=True).withColumn("code", code_of(F.col("code"), F.col("id")))
    d = d.withColumn("ai_probability", I.probability(F.col("code")))
    rows = attach_perplexity(extract_features(d, keep=["id", "ai_probability", ROW]), row_perplexity(d))
    return scoring.explanations_long(scoring.explain(rows)).select("id", "rank", "severity", "feature", "text")


def printed_report(spark, sf):
    """The printed report of every document as code, over all features."""
    d = I.documents(spark, sf, busy=True, placed=True).withColumn("code", code_of(F.col("code"), F.col("id")))
    return scoring.labelled_report(attach_perplexity(extract_features(d, keep=["id", ROW]), row_perplexity(d)))


def trained_scores(spark, sf):
    """Scores of a small calibrated forest on its rebuilt test split."""
    data = extract_features(I.samples(spark, sf).withColumn("language", F.lit("python")), keep=["id", "label", "source"]).drop("error")
    data = cut_lineage(data)
    model = training.train(data, SMALL_FOREST, validate=False)
    return _r(training.predictions(model, data), "p")


QUERIES = {f.__name__: f for f in (
    verdicts, risk_summary, risk_summary_by_source, display_labels, sorted_results, results_with_source, export_table,
    result_messages, result_stream_totals, top_features, corpus_union, corpus_capped, label_normalise, source_counts, class_stats, class_counts,
    undersample, stratified_split, held_out, folds, class_weights, standardise, confusion, confusion_by_source,
    class_report, auc_roc, auc_by_source, average_precision, average_precision_by_source, pr_curve, threshold_search, precision_recall_at_k, score_rank,
    trained_scores, analysis, reasons, printed_report)}

_RES = f"(SELECT id, code, source, lang, {I.PROBABILITY} AS p FROM ({I.DOCUMENTS}) d)"


def _verdict(t: str) -> str:
    return (f"CASE WHEN p IS NULL THEN NULL WHEN p >= least({t} + 0.15::DOUBLE, 0.9::DOUBLE) THEN 'Vjerojatno AI' WHEN p >= {t} THEN 'Moguće AI' WHEN p >= {t} - 0.2::DOUBLE "
            f"THEN 'Nejasno' WHEN p >= {t} - 0.4::DOUBLE THEN 'Moguće čovječji' ELSE 'Vjerojatno čovječji' END")


_SUMMARY = ("count(*) AS total, count(*) FILTER (WHERE p >= 0.7::DOUBLE) AS high_risk, count(*) FILTER (WHERE p >= 0.4::DOUBLE AND p < 0.7::DOUBLE) AS medium_risk, "
            "count(*) FILTER (WHERE p < 0.4::DOUBLE) AS low_risk, round(coalesce(avg(p), 0), 4) AS avg_ai_probability")
_PCT = "floor(coalesce(p, 0) * 100 + 0.5)::BIGINT"


def _top_sql() -> str:
    from authorlens.catalog.text_queries import _JUDGED
    weights = {"trailing_whitespace_ratio": 0.25, "empty_line_ratio": 0.16, "max_line_length": 0.15, "avg_line_length": 0.15,
               "token_entropy": 0.13}
    return (f"WITH judged AS {_JUDGED} " + " UNION ALL ".join(
        f"SELECT id, {i}::BIGINT AS rank, '{n}' AS name, round({n}::DOUBLE, 4) AS value, {w}::DOUBLE AS importance FROM judged"
        for i, (n, w) in enumerate(weights.items(), 1)))


ORACLE = {
    "verdicts": f"SELECT id, round(p, 4) AS ai_probability, {_verdict('0.65::DOUBLE')} AS verdict, {_verdict('0.8::DOUBLE')} AS verdict_at_80 FROM {_RES} r",
    "result_stream_totals": f"SELECT (SELECT count(*) FROM documents) AS results, {_SUMMARY} FROM {_RES} r",
    "risk_summary": f"SELECT {_SUMMARY} FROM {_RES} r",
    "risk_summary_by_source": f"SELECT source, {_SUMMARY} FROM {_RES} r GROUP BY source",
    "display_labels": f"SELECT id, {_PCT} AS percent, CASE WHEN {_PCT} >= 70 THEN 'LIKELY AI' WHEN {_PCT} >= 40 THEN 'POSSIBLY AI' ELSE 'LIKELY HUMAN' END AS label, "
                      f"CASE WHEN p >= 0.7::DOUBLE THEN 'high' WHEN p >= 0.4::DOUBLE THEN 'medium' WHEN p IS NOT NULL THEN 'low' END AS bucket FROM {_RES} r",
    "sorted_results": f"SELECT id, round(p, 6) AS ai_probability FROM {_RES} r ORDER BY p DESC NULLS LAST, id",
    "results_with_source": f"SELECT id, round(p, 4) AS ai_probability, source AS file, length(code) AS n_chars FROM {_RES} r",
    "export_table": f"SELECT id::VARCHAR AS id, id || '.py' AS file, lang AS language, {_PCT} || '%' AS percent, coalesce({_verdict('0.65::DOUBLE')}, '') AS verdict FROM {_RES} r",
    "result_messages": f"SELECT 'result' AS type, id, round(p, 6) AS ai_probability, source FROM {_RES} r",
    "top_features": _top_sql(),
    "corpus_union": f"SELECT id, label, 'python' AS language, source, length(code) AS n_chars FROM {_UNION_SQL} u",
    "corpus_capped": f"SELECT id, label, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM {_UNION_SQL} u "
                     f"WHERE source IN ('AIGCodeSet', 'ai-code-detection')) v WHERE r <= 200",
    "label_normalise": "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN quality ELSE 1 END AS from_text, quality AS from_number, "
                       "toxic AS from_flag FROM documents JOIN labels USING (doc_id)",
    "source_counts": f"SELECT source, count(*) AS n FROM {_UNION_SQL} u GROUP BY source",
    "class_stats": f"SELECT total, human, ai, round(human * 100.0::DOUBLE / total, 6) AS human_percent, round(ai * 100.0::DOUBLE / total, 6) AS ai_percent, "
                   f"(ai // greatest(human, 1))::BIGINT AS ai_per_human, ai / greatest(human, 1) > 5 AS imbalanced, human = 0 AS no_human, 42::BIGINT AS n_features FROM "
                   f"(SELECT count(*) AS total, count(*) FILTER (WHERE label = 0) AS human, count(*) FILTER (WHERE label = 1) AS ai FROM {_UNION_SQL} u) c",
    "class_counts": f"SELECT label, count(*) AS n FROM ({I.SAMPLES}) s GROUP BY label",
    "undersample": f"SELECT id, label FROM {_UNDER} u",
    "stratified_split": f"SELECT id, label, rk <= round(np * 0.2::DOUBLE) AS is_test FROM {_RANKED} r",
    "held_out": f"SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH}, id) AS rk, count(*) OVER (PARTITION BY label) AS np "
                f"FROM {_UNDER} u) v WHERE rk <= round(np * 0.2::DOUBLE)",
    "folds": f"SELECT id, label, ((rk - 1) % 5)::BIGINT AS fold FROM {_RANKED} r",
    "class_weights": f"SELECT label, n, round(sum(n) OVER () / (n * 2.0::DOUBLE), 6) AS weight FROM (SELECT label, count(*) AS n FROM ({I.SAMPLES}) s GROUP BY label) c",
    "standardise": f"SELECT id, round((length(code) - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 6) AS a, 0.0::DOUBLE AS b FROM {_RANKED} r, (SELECT avg(length(code)) AS m, "
                   f"stddev_pop(length(code)) AS d FROM {_RANKED} r WHERE NOT (rk <= round(np * 0.2::DOUBLE))) t",
    "confusion": f"SELECT tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp FROM {_CM} c",
    "confusion_by_source": f"SELECT source, count(*) FILTER (WHERE p <= 0.5 AND y_true <> 1) AS tn, count(*) FILTER (WHERE p > 0.5 AND y_true <> 1) AS fp, "
                           f"count(*) FILTER (WHERE p <= 0.5 AND y_true = 1) AS fn, count(*) FILTER (WHERE p > 0.5 AND y_true = 1) AS tp FROM ({I.PREDICTIONS}) x GROUP BY source",
    "class_report": f"WITH c AS {_CM}, m AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn + fp AS n0, tp + fn AS n1 FROM c), "
                    f"k AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM m) "
                    f"SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, n0::BIGINT AS support FROM k "
                    f"UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(k.f1, 6), n1::BIGINT FROM k "
                    f"UNION ALL SELECT 'accuracy', round((tn + tp) / (n0 + n1), 6), round((tn + tp) / (n0 + n1), 6), round((tn + tp) / (n0 + n1), 6), (n0 + n1)::BIGINT FROM k "
                    f"UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + k.f1) / 2, 6), (n0 + n1)::BIGINT FROM k "
                    f"UNION ALL SELECT 'weighted avg', round((p0 * n0 + p1 * n1) / (n0 + n1), 6), round((r0 * n0 + r1 * n1) / (n0 + n1), 6), "
                    f"round((f0 * n0 + k.f1 * n1) / (n0 + n1), 6), (n0 + n1)::BIGINT FROM k",
    "auc_roc": f"WITH x AS ({I.PREDICTIONS}), r AS (SELECT y_true, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM x) "
               f"SELECT round((sum(rk) FILTER (WHERE y_true = 1) - count(*) FILTER (WHERE y_true = 1) * (count(*) FILTER (WHERE y_true = 1) + 1) / 2.0::DOUBLE) / "
               f"(count(*) FILTER (WHERE y_true = 1) * count(*) FILTER (WHERE y_true <> 1)), 6) AS auc_roc FROM r",
    "auc_by_source": f"WITH x AS ({I.PREDICTIONS}), pairs AS (SELECT a.source, sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS s "
                     f"FROM x a JOIN x b ON a.source = b.source AND a.y_true = 1 AND b.y_true <> 1 GROUP BY a.source), n AS (SELECT source, count(*) FILTER (WHERE y_true = 1) AS np, "
                     f"count(*) FILTER (WHERE y_true <> 1) AS nn FROM x GROUP BY source) SELECT source, round(coalesce(s / nullif(np * nn, 0), 0), 6) AS auc_roc FROM n LEFT JOIN pairs USING (source)",
    "average_precision_by_source": f"WITH x AS ({I.PREDICTIONS}), c AS (SELECT source, p, count(*) FILTER (WHERE y_true = 1)::DOUBLE AS pos, count(*) AS n FROM x GROUP BY source, p), "
                                   f"w AS (SELECT *, sum(pos) OVER q AS tp, sum(n) OVER q AS seen, sum(pos) OVER (PARTITION BY source) AS np FROM c "
                                   f"WINDOW q AS (PARTITION BY source ORDER BY p DESC)) SELECT source, round(coalesce(sum(pos / nullif(np, 0) * tp / seen), 0), 6) AS average_precision "
                                   f"FROM w GROUP BY source",
    "average_precision": f"SELECT round(sum(pos / np * tp / (tp + fp)), 6) AS average_precision FROM {_CURVE} c",
    "pr_curve": f"SELECT round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM {_CURVE} c "
                f"UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE",
    "threshold_search": _threshold_sql("p", "strict") + " UNION ALL " + _threshold_sql("1 - p", "flipped"),
    "precision_recall_at_k": f"WITH r AS (SELECT *, row_number() OVER w AS rk, sum((y_true = 1)::INT) OVER w AS hits FROM ({I.PREDICTIONS}) x WINDOW w AS (ORDER BY p DESC, id)) "
                             f"SELECT rk AS k, round(p, 6) AS threshold, round(hits / rk::DOUBLE, 6) AS precision, round(hits / (SELECT count(*) FROM r WHERE y_true = 1)::DOUBLE, 6) "
                             f"AS recall FROM r WHERE rk IN (10, 20, 50, 100, 200, 500, 1000)",
    "score_rank": f"SELECT id, row_number() OVER w AS rank, (sum((y_true = 1)::INT) OVER w)::BIGINT AS positives FROM ({I.PREDICTIONS}) x WINDOW w AS (ORDER BY p DESC, {_HASH}, id "
                  f"ROWS UNBOUNDED PRECEDING)",
}
