"""Gates, verdicts, risk, top features, explanations and summaries over result rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from authorlens import schemas
from authorlens.functions import rules
from authorlens.functions.text import let, nonblank_lines, strip, unnest

# Fixed values.
MIN_LINES = 5
MAX_CHARS = 100_000
DEFAULT_THRESHOLD = 0.65
VERDICTS = ["Vjerojatno AI", "Moguće AI", "Nejasno", "Moguće čovječji", "Vjerojatno čovječji"]
TOO_SHORT_VERDICT = "Premalo koda za analizu"
NO_MODEL_VERDICT = "Model nije dostupan"
EMPTY_ERROR = "Prazni kod."
TOO_LONG_ERROR = "Kod je predugačak. Maksimalno 100.000 znakova."
NO_MODEL_ERROR = "Model nije treniran."
TOO_SHORT_ERROR = ("Analiza zahtijeva najmanje 5 nepraznih linija koda. Predani isječak ima %d (%s).")
SUSPICIOUS = 0.70
CATEGORIES = {
    "Style": ["avg_identifier_length", "avg_function_name_length", "single_char_name_ratio", "naming_consistency",
              "comment_ratio", "num_docstrings", "lexical_diversity", "trailing_whitespace_ratio"],
    "Structure": ["num_functions", "avg_function_length", "max_nesting_depth", "cyclomatic_complexity_approx",
                  "if_density", "for_density", "ast_depth"],
    "Statistical": ["char_entropy", "token_entropy", "perplexity"],
}
STRONG_KEYS = ["avg_identifier_length", "avg_function_name_length", "naming_consistency", "comment_ratio",
               "num_docstrings"]
MEDIUM_KEYS = ["token_entropy", "char_entropy", "cyclomatic_complexity_approx", "avg_function_length"]


# ------------------------------------------------------------------ gate

def gate(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Strips ``code`` and adds ``gate_verdict`` and ``error``; no row is dropped.

    ``max_chars`` applies to interactive single requests only, so batches leave it out.
    """
    out = df.withColumn("code", strip(F.coalesce(F.col("code"), F.lit(""))))
    out = out.withColumn("_filled", nonblank_lines(F.col("code")))
    n = F.col("_filled")
    noun = F.when(n == 1, F.lit("liniju")).when(n < 5, F.lit("linije")).otherwise(F.lit("linija"))
    too_long = F.lit(False) if max_chars is None else F.length("code") > max_chars
    return out.withColumns({
        "error": F.when(F.col("code") == "", F.lit(EMPTY_ERROR)).when(too_long, F.lit(TOO_LONG_ERROR))
        .when(n < MIN_LINES, F.format_string(TOO_SHORT_ERROR, n, noun)),
        "gate_verdict": F.when((F.col("code") != "") & ~too_long & (n < MIN_LINES), F.lit(TOO_SHORT_VERDICT)),
        "meaningful_lines": n,
    }).drop("_filled")


# ------------------------------------------------------------------ tiers

def verdict(p: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    bounds = [min(threshold + 0.15, 0.90), threshold, threshold - 0.20, threshold - 0.40]
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for bound, name in zip(bounds, VERDICTS):
        out = out.when(p >= bound, F.lit(name))
    return out.otherwise(F.lit(VERDICTS[-1]))


def risk_bucket(p: Column) -> Column:
    """Server-side bucket on the raw probability; null stays out of every bucket."""
    return (F.when(p.isNull(), F.lit(None).cast("string")).when(p >= 0.70, F.lit("high"))
            .when(p >= 0.40, F.lit("medium")).otherwise(F.lit("low")))


def percent(x: Column) -> Column:
    """Whole percent, halves upwards, null as zero."""
    return F.floor(F.coalesce(x, F.lit(0.0)) * 100 + 0.5).cast("bigint")


def display_label(p: Column) -> Column:
    q = percent(p)
    return F.when(q >= 70, F.lit("LIKELY AI")).when(q >= 40, F.lit("POSSIBLY AI")).otherwise(F.lit("LIKELY HUMAN"))


def similarity_tier(similarity: Column) -> Column:
    q = percent(similarity)
    return (F.when(q >= 80, F.lit("Very high similarity")).when(q >= 60, F.lit("High similarity"))
            .when(q >= 40, F.lit("Moderate")).otherwise(F.lit("Low similarity")))


def perplexity_reading(x: Column) -> Column:
    return (F.when(x < 5, F.lit("vrlo nizak → vjerojatno AI")).when(x < 20, F.lit("nizak → moguće AI"))
            .when(x < 60, F.lit("srednji → nejasno")).otherwise(F.lit("visok → vjerojatno čovjek")))


def model_value(name: str) -> Column:
    """Value a model sees: missing is 0, and so is a perplexity that was not computed."""
    v = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return F.when(v == -1.0, F.lit(0.0)).otherwise(v) if name == "perplexity" else v


# ------------------------------------------------------------------ per-feature views

def long_features(df: DataFrame, names: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Unpivot: ``(id, name, value)`` in feature order; a narrow step."""
    names = names or schemas.FEATURES
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    keys = keys or ["id"]
    return unnest(df.select(*keys, entries.alias("_a")), keys, "_a").select(*keys, "_e.*")


def severity_analyze(name: Column, value: Column) -> Column:
    """Severity on the single-text screen."""
    return (F.when(name.isin(STRONG_KEYS), F.when(value > 5, F.lit("high")).otherwise(F.lit("medium")))
            .when(name.isin(MEDIUM_KEYS), F.lit("medium")).otherwise(F.lit("low")))


def severity_detail(name: Column, value: Column) -> Column:
    """Severity on the detail screen."""
    return (F.when(F.contains(name, F.lit("length")) & (value > 6), F.lit("high"))
            .when((name == "naming_consistency") & (value > 0.7), F.lit("high"))
            .when((name == "comment_ratio") & (value > 0.2), F.lit("high"))
            .when(F.contains(name, F.lit("entropy")), F.lit("medium")).otherwise(F.lit("low")))


def category(name: Column) -> Column:
    out = None
    for label, keys in CATEGORIES.items():
        out = F.when(name.isin(keys), F.lit(label)) if out is None else out.when(name.isin(keys), F.lit(label))
    return out


def feature_report(df: DataFrame, available: list[str] | None = None) -> DataFrame:
    """``(id, category, name, value, severity)`` of the features the detail screen groups."""
    wanted = [n for keys in CATEGORIES.values() for n in keys if n in (available or df.columns)]
    out = long_features(df, wanted)
    return out.select("id", category(F.col("name")).alias("category"), "name", "value",
                      severity_detail(F.col("name"), F.col("value")).alias("severity"))


# Sections of the printed report and the label of each name in it, in its order.
REPORT = {
    "STILSKA DETEKCIJA — komentari, imenovanje, formatiranje": {
        "num_comment_lines": "Broj linija s komentarom", "comment_ratio": "Udio komentara (%)", "avg_comment_length_words": "Prosj. duljina komentara (rij.)",
        "comment_to_code_ratio": "Udio komentara u znakovima", "num_block_comments": "Broj blok komentara", "num_docstrings": "Broj docstringova / JSDoc",
        "avg_identifier_length": "Prosj. duljina identifikatora", "avg_function_name_length": "Prosj. duljina naziva funkcija",
        "single_char_name_ratio": "Udio jednoslovnih naziva", "lexical_diversity": "Leksička raznolikost naziva", "snake_case_ratio": "Udio snake_case stila",
        "camel_case_ratio": "Udio camelCase stila", "naming_consistency": "Konzistentnost imenovanja", "total_lines": "Ukupno linija",
        "empty_line_ratio": "Udio praznih linija", "avg_line_length": "Prosj. duljina linije (znakovi)", "max_line_length": "Max duljina linije",
        "uses_tabs": "Koristi tabove (1=da, 0=ne)", "trailing_whitespace_ratio": "Udio linija s trailing space",
        "operator_spacing_consistency": "Konzistentnost razmaka operatori"},
    "STRUKTURNA DETEKCIJA — AST, složenost, tok kontrole": {
        "ast_depth": "Dubina AST stabla", "ast_node_count": "Broj čvorova u AST stablu", "unique_node_type_ratio": "Raznolikost tipova čvorova",
        "num_functions": "Broj funkcija / metoda", "avg_function_length": "Prosj. duljina funkcije (linije)", "max_function_length": "Max duljina funkcije (linije)",
        "avg_args_per_function": "Prosj. broj argumenata", "num_classes": "Broj klasa", "num_imports": "Broj importa", "num_if_statements": "Broj if naredbi",
        "num_for_loops": "Broj for petlji", "num_while_loops": "Broj while petlji", "num_try_blocks": "Broj try/catch blokova", "num_lambdas": "Broj lambda izraza",
        "max_nesting_depth": "Max dubina ugniježđenosti", "avg_nesting_depth": "Prosj. dubina ugniježđenosti",
        "cyclomatic_complexity_approx": "Aproks. ciklomatska složenost"},
    "STATISTIČKA DETEKCIJA — perplexity": {"perplexity": "Perplexity"},
}
NO_PERPLEXITY = "Model nije učitan — perplexity nije izračunat."
READING = "Tumačenje"


def labelled_report(df: DataFrame) -> DataFrame:
    """``(id, place, section, label, shown)``: the printed report as rows, one per line of it; a narrow step.

    Fractions have four digits, whole numbers none, names that the row does not have are ``N/A``.
    Without a model one line says so in place of perplexity and its reading.
    """
    entries = []
    for section, labels in REPORT.items():
        for name, label in labels.items():
            if name not in df.columns:
                shown = F.lit("N/A")
            elif name in schemas.INTEGER_FEATURES:
                shown = F.coalesce(F.col(name).cast("bigint").cast("string"), F.lit("N/A"))
            else:
                shown = F.coalesce(F.format_string("%.4f", F.bround(F.col(name).cast("double"), 4)), F.lit("N/A"))
            entries.append((section, F.lit(label), shown))
    if "perplexity" in df.columns:
        there = F.coalesce(F.col("model_available"), F.lit(0)) != 0
        section, label, shown = entries.pop()
        entries.append((section, F.when(there, label).otherwise(F.lit(NO_PERPLEXITY)), F.when(there, shown)))
        entries.append((section, F.when(there, F.lit(READING)), perplexity_reading(F.col("perplexity"))))
    rows = F.array(*[F.when(label.isNotNull(), F.struct(F.lit(i).cast("bigint").alias("place"), F.lit(section).alias("section"), label.alias("label"), shown.alias("shown")))
                     for i, (section, label, shown) in enumerate(entries, 1)])
    return unnest(df.select("id", F.array_compact(rows).alias("_a")), ["id"], "_a").select("id", "_e.*")


def feature_groups(df: DataFrame) -> DataFrame:
    """Number and sorted names of the report features per submission and category, inside the row."""
    parts = []
    for label, keys in CATEGORIES.items():
        names = [n for n in keys if n in df.columns]
        present = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))
        parts.append(F.struct(F.lit(label).alias("category"), F.size(present).cast("bigint").alias("n"),
                              F.sort_array(present).alias("names")))
    return unnest(df.select("id", F.array(*parts).alias("_a")), ["id"], "_a").select("id", "_e.*").filter("n > 0")


def top_features(df: DataFrame, importances: DataFrame, k: int = 5) -> DataFrame:
    """Adds ``top_features``: the ``k`` most important features with their values.

    ``importances(name, importance)`` has one row per model feature, so it is folded
    into a single row and broadcast; ties go to the later feature as in a reversed sort.
    """
    order = {n: i for i, n in enumerate(schemas.MODEL_FEATURES)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    best = (importances.withColumn("pos", F.try_element_at(place, F.col("name")))
            .orderBy(F.desc("importance"), F.desc("pos")).limit(k)
            .agg(F.sort_array(F.collect_list(F.struct("importance", "pos", "name")), asc=False).alias("best")))
    values = F.create_map(*[x for n in schemas.MODEL_FEATURES if n in df.columns
                            for x in (F.lit(n), model_value(n))])
    # the values are made once for all of the best names: within the function over these they would be made for each
    return df.withColumn("_best", best.scalar()).withColumn("top_features", let(values, lambda v: F.transform("_best", lambda b: F.struct(
        b["name"].alias("name"), F.round(F.try_element_at(v, b["name"]), 4).alias("value"),
        F.round(b["importance"], 4).alias("importance"))))).drop("_best")


# ------------------------------------------------------------------ explanations

def explain(df: DataFrame, probability: str = "ai_probability", strict: bool = True) -> DataFrame:
    """Adds ``explanations``; rows with an error get none."""
    text = rules.explanations(F.col(probability), strict)
    if "error" in df.columns:
        text = F.when(F.col("error").isNull(), text)
    return df.withColumn("explanations", text)


def explanations_long(df: DataFrame) -> DataFrame:
    return unnest(df, ["id"], "explanations", "pos").select(
        "id", (F.col("pos") + 1).cast("bigint").alias("rank"), "_e.*")


def severity_counts(df: DataFrame) -> DataFrame:
    """Strong, moderate and human signals per submission, counted inside the row."""
    def n(severity: str) -> Column:
        return F.size(F.filter("explanations", lambda e: e["severity"] == severity)).cast("bigint")

    return df.select("id", n("high").alias("strong"), n("medium").alias("moderate"), n("positive").alias("human"))


# ------------------------------------------------------------------ sets of results

def batch_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals and risk counts; errors count in ``total`` only.  Partial sums precede the shuffle."""
    p = F.col("ai_probability")
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(p >= 0.70).alias("high_risk"),
        F.count_if((p >= 0.40) & (p < 0.70)).alias("medium_risk"),
        F.count_if(p < 0.40).alias("low_risk"),
        F.round(F.coalesce(F.avg(p), F.lit(0.0)), 4).alias("avg_ai_probability"),
    ]
    return results.groupBy(*(by or [])).agg(*aggs)


def search(results: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search on ``id`` or ``file``; an empty query keeps all rows."""
    if not query:
        return results
    q = F.lit(query.lower())
    fields = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), q), F.lit(False))
              for c in ("id", "file") if c in results.columns]
    return results.filter(reduce(lambda a, b: a | b, fields))


def sort_results(results: DataFrame, key: str = "ai_probability", descending: bool = True) -> DataFrame:
    c = F.col(key)
    return results.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "id")


def attach_source(results: DataFrame, submissions: DataFrame) -> DataFrame:
    """Result rows with the file name and the code they came from."""
    file = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("file", "filename") if c in submissions.columns],
                      F.col("id").cast("string"))
    return results.join(submissions.select("id", file.alias("file"), "code"), "id", "left")
