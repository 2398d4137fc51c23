"""Queries over texts: languages, lines, tokens, names, annotations, explanations."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from authorlens import schemas
from authorlens.catalog import inputs as I
from authorlens.functions import annotate, language, style, text
from authorlens.operators import annotations, features, perplexity, scoring, similarity
from authorlens.session import checkpoint_dir
from authorlens.sources.readers import id_of_file, is_accepted

WS, WORD = I.WS, I.WORD


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) if t == "double" else F.col(c)
                              for c, t in df.dtypes if c not in keys])


# ------------------------------------------------------------------ languages

def lang_scores(spark, sf):
    scores = language.content_scores(F.col("code"))
    return I.texts(spark, sf).select("id", *[c.alias(f"score_{n}") for n, c in scores.items()])


_L, _R = rf"(?:^|[^{WORD}])", rf"(?:[^{WORD}]|$)"
_S, _W = f"[{WS}]", f"[{WORD}]"
_RULES = {
    "python": [(3, [rf"{_L}def{_S}+{_W}+{_S}*\("]), (2, ['"""']), (2, [rf"{_L}self{_R}"]),
               (1, [rf"{_L}print{_S}*\("]), (1, [rf":{_S}*(?:\n|\z)"])],
    "javascript": [(2, [rf"{_L}const{_S}+{_W}+{_S}*="]), (3, [rf"=>{_S}*[{{(]"]), (3, [rf"{_L}console\.log{_R}"])],
    "typescript": [(4, [rf":{_S}*(?:string|number|boolean|void){_R}"]), (4, [rf"{_L}interface{_S}+{_W}+"])],
    "java": [(4, [rf"{_L}public{_S}+class{_R}"]), (3, [rf"{_L}System\.out{_R}"]),
             (2, [rf"{_L}public{_S}+static{_R}"]), (2, [rf"{_L}void{_S}+main{_R}"])],
    "c": [(3, [rf'#include{_S}*[<"]']), (3, [rf"{_L}printf{_S}*\("]), (3, [rf"{_L}scanf{_S}*\("]),
          (3, [rf"{_L}malloc{_S}*\("])],
    "cpp": [(3, [rf'#include{_S}*[<"]']), (4, [rf"{_L}std::"]), (4, [rf"{_L}cout{_R}"]), (4, [rf"{_L}cin{_R}"]),
            (4, [rf"{_L}using{_S}+namespace{_R}"]), (3, [rf"{_L}template{_S}*<"]), (3, [rf"{_L}vector{_S}*<"]),
            (2, [rf"{_L}string{_R}", "#include"])],
    "go": [(4, [rf"{_L}func{_S}+{_W}+{_S}*\("]), (4, [rf"{_L}package{_S}+{_W}+"]), (3, [rf"{_L}fmt\.Print"])],
    "rust": [(4, [rf"{_L}fn{_S}+{_W}+{_S}*\("]), (4, [rf"{_L}let{_S}+mut{_R}"]), (3, [rf"{_L}println!{_S}*\("])],
    "ruby": [(3, [rf"{_L}def{_S}+{_W}+", rf"{_L}end{_R}"]), (3, [rf"{_L}puts{_S}+"])],
}
_SCORES = ", ".join(
    "(" + " + ".join("CASE WHEN " + " AND ".join(f"regexp_matches(code, '{p}')" for p in ps) + f" THEN {w} ELSE 0 END"
                     for w, ps in rules) + f")::BIGINT AS score_{lang}" for lang, rules in _RULES.items())
_LANG_SCORES = f"SELECT id, {_SCORES} FROM ({I.TEXTS}) t"
_BEST = ("CASE greatest(" + ", ".join(f"score_{n}" for n in _RULES) + ") WHEN 0 THEN 'python' "
         + " ".join(f"WHEN score_{n} THEN '{n}'" for n in _RULES) + " END")


def lang_best(spark, sf):
    return I.texts(spark, sf).select("id", language.by_content(F.col("code")).alias("detected_language"))


_EXTENSIONS = [".py", ".JS", ".mjs", ".cjs", ".ts", ".java", ".c", ".H", ".cpp", ".cc", ".cxx", ".hpp", ".go", ".rs",
               ".rb", ".txt", ".tar.c"]
_FILE_SQL = (f"'{'submission_'}' || doc_id || [" + ", ".join(f"'{e}'" for e in _EXTENSIONS)
             + f"][(doc_id % {len(_EXTENSIONS)})::INT + 1]")
_EXT_SQL = ("CASE WHEN f LIKE '%.py' THEN 'python' WHEN regexp_matches(f, '\\.(js|mjs|cjs)$') THEN 'javascript' "
            "WHEN f LIKE '%.ts' THEN 'typescript' WHEN f LIKE '%.java' THEN 'java' "
            "WHEN regexp_matches(f, '\\.(c|h)$') THEN 'c' WHEN regexp_matches(f, '\\.(cpp|cc|cxx|hpp)$') THEN 'cpp' "
            "WHEN f LIKE '%.go' THEN 'go' WHEN f LIKE '%.rs' THEN 'rust' WHEN f LIKE '%.rb' THEN 'ruby' END")


def _with_file(df):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("id") % len(_EXTENSIONS)).cast("int") + 1)
    return df.withColumn("filename", F.concat(F.lit("submission_"), F.col("id").cast("string"), ext))


def lang_by_extension(spark, sf):
    return _with_file(I.documents(spark, sf)).select(
        "id", language.by_extension(F.col("filename")).alias("by_extension"),
        id_of_file(F.col("filename")).alias("file_id"), is_accepted(F.col("filename")).alias("accepted"))


def resolved_language(spark, sf):
    d = _with_file(I.documents(spark, sf))
    given = F.when(F.col("id") % 3 == 0, F.lit("Java"))
    return d.withColumn("language", given).withColumn(
        "filename", F.when(F.col("id") % 2 == 0, F.col("filename"))).transform(features.with_language).select(
        "id", "detected_language")


def unsupported_language(spark, sf):
    return I.documents(spark, sf).select("id", language.unsupported_error(F.col("lang")).alias("error"))


def language_settings(spark, sf):
    d = I.texts(spark, sf).select("id", language.by_content(F.col("code")).alias("language"))
    return language.attach_config(d).select("id", "language", F.col("lang_order").cast("bigint").alias("lang_order"),
                                            "inline_comment", "block_open", "block_close",
                                            F.size("extensions").cast("bigint").alias("n_extensions"))


# ------------------------------------------------------------------ lines

def _lined(spark, sf):
    return features.style_features(features.with_lines(features.with_language(I.texts(spark, sf))))


def line_stats(spark, sf):
    return _rounded(_lined(spark, sf).select("id", "total_lines", "empty_line_ratio", "avg_line_length", "max_line_length"), "id")


def comment_stats(spark, sf):
    return _rounded(_lined(spark, sf).select("id", "num_comment_lines", "comment_ratio", "avg_comment_length_words",
                                             "comment_to_code_ratio"), "id")


def block_doc_counts(spark, sf):
    t = I.texts(spark, sf)
    langs = F.array(*[F.lit(n) for n in language.NAMES])
    # every text under every language's patterns
    return t.select("id", "code", F.explode(langs).alias("language")).select(
        "id", "language", style.block_comments(F.col("code"), F.col("language")).alias("num_block_comments"),
        style.docstrings(F.col("code"), F.col("language")).alias("num_docstrings"))


def whitespace_stats(spark, sf):
    return _rounded(_lined(spark, sf).select("id", "uses_tabs", "trailing_whitespace_ratio"), "id")


def operator_spacing(spark, sf):
    d = I.texts(spark, sf).withColumns(style.operator_counts(F.col("code")))
    return _rounded(d.select("id", F.col("_spaced").alias("spaced"), F.col("_tight").alias("tight"),
                             *[c.alias(n) for n, c in style.operator_features().items()]), "id")


# ------------------------------------------------------------------ tokens

def token_entropy(spark, sf):
    return I.documents(spark, sf, busy=True).select("id", F.round(text.entropy_of(text.tokens_of(F.col("code"))), 6).alias("token_entropy"))


def char_entropy(spark, sf):
    return I.documents(spark, sf, busy=True).select("id", F.round(text.char_entropy(F.col("code")), 6).alias("char_entropy"))


def token_frequencies(spark, sf):
    return perplexity.token_counts(I.documents(spark, sf, busy=True))


def bigram_perplexity(spark, sf):
    return _rounded(perplexity.bigram_perplexity(I.documents(spark, sf, busy=True)), "id")


def stored_perplexity(spark, sf):
    """Turns of conversations under a model of the documents that was written and read back; most of their pairs are new to it."""
    path = f"{checkpoint_dir(spark)}/bigrams-{uuid4()}"
    perplexity.bigram_model(I.documents(spark, sf, busy=True)).save(path)
    turns = I.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("code"))
    return _rounded(perplexity.bigram_perplexity(turns, model=perplexity.load_model(spark, path)), "id")


def perplexity_readings(spark, sf):
    p = perplexity.bigram_perplexity(I.documents(spark, sf, busy=True))
    return p.groupBy(scoring.perplexity_reading(F.col("perplexity")).alias("reading")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ names and structure

def _as_python(spark, sf):
    return I.texts(spark, sf).withColumn("detected_language", F.lit("python"))


def naming_stats(spark, sf):
    return _rounded(features.naming_features(_as_python(spark, sf)).select(
        "id", "avg_identifier_length", "single_char_name_ratio", "lexical_diversity", "snake_case_ratio",
        "camel_case_ratio", "naming_consistency"), "id")


def identifier_counts(spark, sf):
    return features.identifiers(_as_python(spark, sf)).groupBy("name", "is_function_name").agg(F.count(F.lit(1)).alias("n"))


def code_structure(spark, sf):
    out = features.structure_features(_as_python(spark, sf))
    return _rounded(out.select("id", *[c for c in schemas.STRUCTURE if not c.endswith("entropy")]), "id")


def feature_table(spark, sf):
    d = I.documents(spark, sf, busy=True, placed=True)
    rows = features.extract_features(d, keep=["id", perplexity.ROW])
    rows = perplexity.attach_perplexity(rows, perplexity.row_perplexity(d)).select("id", "detected_language", *schemas.FEATURES)
    return _rounded(rows, "id", "detected_language")


# ------------------------------------------------------------------ gates

def submission_gate(spark, sf):
    return scoring.gate(I.documents(spark, sf, busy=True), scoring.MAX_CHARS).select("id", "meaningful_lines", "error", "gate_verdict")


def short_text_gate(spark, sf):
    c = I.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("code"))
    return scoring.gate(c).select("id", "meaningful_lines", "error", "gate_verdict")


def _gate_sql(source: str, limit: bool) -> str:
    long = "length(code) > 100000" if limit else "false"
    return (f"SELECT id, m AS meaningful_lines, CASE WHEN code = '' THEN 'Prazni kod.' WHEN {long} THEN "
            f"'Kod je predugačak. Maksimalno 100.000 znakova.' WHEN m < 5 THEN 'Analiza zahtijeva najmanje 5 nepraznih "
            f"linija koda. Predani isječak ima ' || m || ' (' || CASE WHEN m = 1 THEN 'liniju' WHEN m < 5 THEN 'linije' "
            f"ELSE 'linija' END || ').' END AS error, CASE WHEN code <> '' AND NOT {long} AND m < 5 THEN "
            f"'Premalo koda za analizu' END AS gate_verdict FROM (SELECT s.id, s.code, coalesce(k.m, 0) AS m FROM "
            f"(SELECT id, {I.strip_sql('code')} AS code FROM ({source}) q) s LEFT JOIN (SELECT id, count(*) FILTER "
            f"(WHERE regexp_matches(line, '[^{WS}]')) AS m FROM {I.lines_sql(source)} x GROUP BY id) k USING (id)) z")


def result_search(spark, sf):
    d = _with_file(I.documents(spark, sf)).withColumn("file", F.col("filename"))
    return scoring.search(d, "7.P").select("id", "file")


# ------------------------------------------------------------------ annotations

def annotations_capped(spark, sf):
    return annotations.annotations(_as_python(spark, sf))


def annotation_counts(spark, sf):
    return annotations.annotation_counts(_as_python(spark, sf))


def annotated_source(spark, sf):
    return annotations.annotated_source(I.documents(spark, sf, busy=True).withColumn("detected_language", F.lit("java")))


def annotated_code(spark, sf):
    """Lines of generated code with their marks, under the rules of brace languages."""
    return annotations.annotated_source(I.code(spark, sf).withColumn("detected_language", F.lit("java")))


def _annotations_sql(source: str, lang: str) -> str:
    mark = "#" if lang == "python" else "//"
    reserved = ", ".join(f"'{w}'" for w in annotate.RESERVED)
    hint = (f"WHEN regexp_matches(st, '\\){_S}*->{_S}*{_W}|:{_S}*(?:int|float|str|bool|list|dict|tuple|set|Optional|Union|"
            f"List|Dict){_R}') THEN 'amber|Type annotation — uncommon in student code'") if lang == "python" else ""
    doc = ("WHEN one AND NOT inside THEN 'red|Formal docstring — strong AI indicator' WHEN edge AND NOT inside THEN "
           "'red|Docstring block — strong AI indicator' WHEN inside THEN 'red|Docstring content'") if lang == "python" else ("WHEN starts_with(st, '/**') OR starts_with(st, '* ') OR st = '*/' THEN "
                                       "'red|Formal documentation comment — strong AI indicator'")
    return (
        f"(SELECT id, n, line, CASE {doc} WHEN regexp_matches(line, '^{_S}*{mark}') THEN CASE WHEN cw >= 4 THEN "
        f"'amber|Inline comment (' || cw || ' words) — elevated comment density' END "
        f"WHEN k >= 2 AND s / k >= 9 THEN 'red|Very long identifiers (avg ' || round_even(s / k, 0)::BIGINT || ' chars) — AI naming pattern' "
        f"WHEN k >= 2 AND s / k >= 7 THEN 'amber|Descriptive identifier names (avg ' || round_even(s / k, 0)::BIGINT || ' chars)' {hint} "
        f"WHEN regexp_matches(line, '^{_S}*(?:raise|throw){_S}+{_W}*(?:Error|Exception){_S}*\\(') THEN "
        f"'amber|Explicit exception with message — AI error handling pattern' "
        f"WHEN regexp_matches(line, '^{_S}*(?:except|catch){_S}*[({WORD}]') THEN "
        f"'amber|Exception handling — AI code often handles all edge cases' END AS tn FROM "
        f"(SELECT id, n, line, st, cw, one, edge, len(ids) AS k, list_sum(list_transform(ids, lambda x: length(x)))::DOUBLE AS s, "
        # a line that opens and closes leaves no passage open; any other line with quotes turns the state
        f"coalesce(sum(edge::INT) OVER (PARTITION BY id, ones ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM "
        f"(SELECT *, coalesce(sum(one::INT) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ones FROM "
        f"(SELECT *, marks >= 2 AND length(st) > 6 AS one, marks > 0 AND NOT (marks >= 2 AND length(st) > 6) AS edge FROM "
        f"(SELECT id, n, line, (length(line) - length(replace(line, '\"\"\"', ''))) // 3 AS marks, {I.strip_sql('line')} AS st, {I.count_sql(f'''regexp_replace(line, '^{_S}*{mark}', '')''', f'[^{WS}]+')} AS cw, "
        f"list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(line, '\"[^\"]*\"', '\"\"', 'g'), "
        f"'''[^'']*''', '''''', 'g'), '`[^`]*`', '``', 'g'), '[{WORD}]+'), lambda x: regexp_full_match(x, "
        f"'[a-zA-Z_][a-zA-Z0-9_]{{4,}}') AND lower(x) NOT IN ({reserved})) AS ids FROM {I.lines_sql(source)} l0 "
        f"WHERE regexp_matches(line, '[^{WS}]')) l1) l2) l3) l4)")


def _capped_sql(source: str, lang: str) -> str:
    return (f"(SELECT id, n AS line, split_part(tn, '|', 1) AS tone, split_part(tn, '|', 2) AS note FROM "
            f"(SELECT id, n, tn, filled, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN tn IS NULL THEN 2 WHEN "
            f"tn LIKE 'red|%' THEN 0 ELSE 1 END, n) AS r FROM (SELECT *, count(*) OVER (PARTITION BY id) AS filled FROM "
            f"{_annotations_sql(source, lang)} a0) a1) a2 WHERE tn IS NOT NULL AND r <= greatest(3, floor(filled * 0.40::DOUBLE)))")


# ------------------------------------------------------------------ explanations

_ZERO = [c for c in schemas.FEATURES if c not in (
    "comment_ratio", "num_comment_lines", "total_lines", "empty_line_ratio", "avg_line_length", "max_line_length",
    "trailing_whitespace_ratio", "operator_spacing_consistency", "token_entropy")]


def _judged(spark, sf):
    """Line features and token entropy of every text, the other features at zero."""
    d = _lined(spark, sf).withColumn("token_entropy", text.entropy_of(text.tokens_of(F.col("code"))))
    d = d.withColumn("ai_probability", I.probability(F.col("code")))
    keep = ["id", "ai_probability", *[c for c in schemas.FEATURES if c not in _ZERO]]
    return d.select(*keep, *[F.lit(0.0).alias(c) for c in _ZERO])


def explanations_long(spark, sf):
    return scoring.explanations_long(scoring.explain(_judged(spark, sf))).select("id", "rank", "severity", "feature")


def severity_counts(spark, sf):
    return scoring.severity_counts(scoring.explain(_judged(spark, sf)))


def severity_by_feature(spark, sf):
    names = ["comment_ratio", "avg_line_length", "max_line_length", "token_entropy", "empty_line_ratio"]
    long = scoring.long_features(_judged(spark, sf), names)
    return long.select("id", "name", F.round("value", 6).alias("value"),
                       scoring.severity_analyze(F.col("name"), F.col("value")).alias("severity_analyze"),
                       scoring.severity_detail(F.col("name"), F.col("value")).alias("severity_detail"))


def feature_report(spark, sf):
    r = scoring.feature_report(_judged(spark, sf), ["comment_ratio", "trailing_whitespace_ratio", "token_entropy", "perplexity"])
    return r.groupBy("category", "name", "severity").agg(F.count(F.lit(1)).alias("n"))


def style_report(spark, sf):
    """The printed report of every text; names without an SQL twin are left out of the row, so they show as missing."""
    d = _lined(spark, sf).drop("num_block_comments", "num_docstrings")
    return scoring.labelled_report(d)


_LINE_SQL = (
    f"SELECT id, code, greatest(count(line), 1) AS total_lines, count(line) AS n_lines, "
    f"count(*) FILTER (WHERE line IS NOT NULL AND regexp_matches(line, '[^{WS}]')) AS filled, "
    f"coalesce(sum(length(line)) FILTER (WHERE regexp_matches(line, '[^{WS}]')), 0)::DOUBLE AS chars, "
    f"coalesce(max(length(line)) FILTER (WHERE regexp_matches(line, '[^{WS}]')), 0)::BIGINT AS max_line_length, "
    f"count(*) FILTER (WHERE starts_with(line, chr(9))) AS tabbed, "
    f"count(*) FILTER (WHERE regexp_matches(line, '[{WS}]\\z')) AS trail_n, "
    f"count(*) FILTER (WHERE hit) AS comments, coalesce(sum(length(line)) FILTER (WHERE hit), 0)::DOUBLE AS comment_chars, "
    f"coalesce(sum(cw) FILTER (WHERE hit), 0)::DOUBLE AS comment_words FROM (SELECT t.id, t.code, l.line, "
    f"regexp_matches(l.line, CASE WHEN b.best IN ('python', 'ruby') THEN '^{_S}*#' ELSE '^{_S}*//' END) AS hit, "
    f"len(regexp_extract_all(regexp_replace(l.line, CASE WHEN b.best IN ('python', 'ruby') THEN '^{_S}*#' ELSE "
    f"'^{_S}*//' END, ''), '[^{WS}]+')) AS cw FROM ({I.TEXTS}) t JOIN (SELECT id, {_BEST} AS best FROM ({_LANG_SCORES}) s0) b "
    f"USING (id) LEFT JOIN {I.lines_sql(I.TEXTS)} l USING (id)) j GROUP BY id, code")
_SPACED = I.count_sql("code", rf"[{WS}][=!<>]=?[{WS}]")
_TIGHT = I.count_sql("code", rf"[^{WS}=!<>][=!<>]=[^{WS}=]")
_ENTROPY = ("log2(sum(c)::DOUBLE) - sum(c * log2(c::DOUBLE)) / sum(c)")


def _entropy_sql(source: str, items: str, name: str) -> str:
    return (f"SELECT d.id, round(greatest(coalesce(h, 0), 0), 6) AS {name} FROM ({source}) d LEFT JOIN (SELECT id, {_ENTROPY} AS h "
            f"FROM (SELECT id, x, count(*) AS c FROM (SELECT id, unnest({items}) AS x FROM ({source}) e0) e1 GROUP BY id, x) e2 "
            f"GROUP BY id) e USING (id)")


_BIGRAMS = (f"(SELECT id, toks[i] AS a, toks[i] || ' ' || toks[i + 1] AS pair, count(*) AS n FROM (SELECT id, toks, "
            f"unnest(range(1, len(toks))) AS i FROM (SELECT id, regexp_extract_all(code, '{I.TOKEN}') AS toks FROM "
            f"({I.DOCUMENTS}) b0) b1) b2 GROUP BY ALL)")
_PERPLEXITY = (
    f"(WITH big AS {_BIGRAMS}, voc AS (SELECT count(DISTINCT t) AS v FROM (SELECT unnest(regexp_extract_all(code, '{I.TOKEN}')) "
    f"AS t FROM ({I.DOCUMENTS}) v0) v1), pairs AS (SELECT pair, a, sum(n) AS np FROM big GROUP BY pair, a), firsts AS (SELECT a, "
    f"sum(n) AS nf FROM big GROUP BY a) SELECT d.id, coalesce(sum(big.n), 0)::BIGINT AS n_pairs, "
    f"coalesce(exp(-sum(big.n * ln((np + 1.0)::DOUBLE / (nf + v)::DOUBLE)) / sum(big.n)), -1.0) AS perplexity FROM ({I.DOCUMENTS}) d "
    f"LEFT JOIN big USING (id) LEFT JOIN pairs USING (pair, a) LEFT JOIN firsts USING (a), voc GROUP BY d.id)")

_NAME = rf"[\p{{L}}_$][{WORD}$]*"
_PY_LEX = (r"#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\z)|'''''''[\s\S]*?(?:'''''''|\z)".replace("'''''''", "''''''")
           .replace(r"\"", '"')
           + r'|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"?|' + r"''[^''\\\n]*(?:\\[\s\S][^''\\\n]*)*''?)"
           + rf"|\n[ \t]*(?:(?:async[ \t]+)?(?:def|class)[ \t]+)?(?:{_NAME})?|{_NAME}|[0-9][{WORD}.]*|=>|->|[^{WORD}{WS}]")


def _names_sql() -> str:
    from authorlens.functions.naming import KEYWORDS
    words = ", ".join(f"'{k}'" for k in KEYWORDS)
    return (f"(SELECT id, nm FROM (SELECT id, regexp_extract(tok, '({_NAME})\\z', 1) AS nm, tok FROM (SELECT id, "
            f"ltrim(unnest(regexp_extract_all(chr(10) || code, '{_PY_LEX}')), chr(10) || ' ' || chr(9)) AS tok FROM ({I.TEXTS}) n0) n1 "
            f"WHERE regexp_matches(tok, '^(?:(?:async[ \\t]+)?(?:def|class)[ \\t]+)?{_NAME}\\z')) n2 "
            f"WHERE nm NOT IN ({words}))")


def _functions_sql() -> str:
    """Names behind a def that starts a line outside brackets."""
    tokens = (f"(SELECT id, generate_subscripts(ts, 1) AS i, unnest(ts) AS tok FROM (SELECT id, regexp_extract_all(chr(10) || code, '{_PY_LEX}') AS ts FROM ({I.TEXTS}) f0) f1)")
    # the depth never falls below zero: a closing bracket too many counts for nothing
    return (f"(SELECT id, nm FROM (SELECT id, nm, raw - least(0, min(raw) OVER (PARTITION BY id ORDER BY i)) AS open FROM (SELECT id, i, "
            f"regexp_extract(tok, '^\\n[ \\t]*(?:async[ \\t]+)?def[ \\t]+({_NAME})\\z', 1) AS nm, "
            f"sum(CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS raw "
            f"FROM {tokens} f2) f3) f4 WHERE nm <> '' AND open = 0)")


_NAMING = (
    f"SELECT t.id, round(coalesce(avg(length(nm)), 0), 6) AS avg_identifier_length, "
    f"round(coalesce(avg((length(nm) = 1)::INT), 0), 6) AS single_char_name_ratio, "
    f"round(coalesce(count(DISTINCT nm) / nullif(count(nm), 0)::DOUBLE, 0), 6) AS lexical_diversity, "
    f"round(coalesce(avg(sn), 0), 6) AS snake_case_ratio, round(coalesce(avg(ca), 0), 6) AS camel_case_ratio, "
    f"round(coalesce(greatest(sum(sn), sum(ca), sum(pa)) / nullif(count(nm), 0)::DOUBLE, 0), 6) AS naming_consistency "
    f"FROM ({I.TEXTS}) t LEFT JOIN (SELECT id, nm, (contains(nm, '_') AND nm = lower(nm) AND NOT starts_with(nm, '_'))::INT AS sn, "
    f"(length(nm) > 1 AND NOT contains(nm, '_') AND regexp_matches(nm, '^\\p{{Ll}}') AND regexp_matches(nm, '\\p{{Lu}}'))::INT AS ca, "
    f"(length(nm) > 1 AND NOT contains(nm, '_') AND regexp_matches(nm, '^\\p{{Lu}}') AND regexp_matches(nm, '\\p{{Ll}}'))::INT AS pa "
    f"FROM {_names_sql()} n) x USING (id) GROUP BY t.id")

_JUDGED = (
    f"(SELECT k.*, comments / total_lines AS comment_ratio, (total_lines - filled) / total_lines AS empty_line_ratio, "
    f"coalesce(chars / nullif(filled, 0), 0) AS avg_line_length, trail_n / total_lines AS trailing_whitespace_ratio, "
    f"coalesce(greatest({_SPACED}, {_TIGHT}) / nullif({_SPACED} + {_TIGHT}, 0)::DOUBLE, 0) AS operator_spacing_consistency, "
    f"e.token_entropy, {I.PROBABILITY} AS p FROM ({_LINE_SQL}) k JOIN ("
    + _entropy_sql(I.TEXTS, f"regexp_extract_all(code, '{I.TOKEN}')", "token_entropy").replace("round(greatest(coalesce(h, 0), 0), 6)", "greatest(coalesce(h, 0), 0)")
    + ") e USING (id))")
_SPOKEN = [
    (4, "comment_ratio", "CASE WHEN comment_ratio > 0.30 THEN 'high' WHEN comment_ratio > 0.18 THEN 'medium' WHEN comment_ratio < 0.03 THEN 'positive' END"),
    (9, "token_entropy", "CASE WHEN token_entropy > 0 AND token_entropy < 3.8 THEN 'high' WHEN token_entropy > 5.5 THEN 'positive' END"),
    (11, "trailing_whitespace_ratio", "CASE WHEN trailing_whitespace_ratio > 0.15 THEN 'positive' WHEN trailing_whitespace_ratio = 0 THEN 'high' WHEN trailing_whitespace_ratio < 0.02 THEN 'medium' END"),
    (12, "operator_spacing_consistency", "CASE WHEN operator_spacing_consistency >= 0.98 THEN 'high' WHEN operator_spacing_consistency > 0.90 THEN 'medium' END"),
    (13, "empty_line_ratio", "CASE WHEN empty_line_ratio >= 0.05 AND empty_line_ratio <= 0.20 THEN 'medium' END"),
    (14, "avg_line_length", "CASE WHEN avg_line_length > 60 THEN 'high' WHEN avg_line_length > 40 THEN 'medium' END"),
    (15, "max_line_length", "CASE WHEN max_line_length > 100 THEN 'medium' END"),
    (20, "unique_node_type_ratio", "'medium'"),
]
_EXPLAINED = ("(" + " UNION ALL ".join(f"SELECT id, {o} AS ord, '{f}' AS feature, {c} AS severity FROM judged" for o, f, c in _SPOKEN) + ")")
_SEVERITY_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"

QUERIES = {f.__name__: f for f in (
    lang_scores, lang_best, lang_by_extension, resolved_language, unsupported_language, language_settings, line_stats,
    comment_stats, block_doc_counts, whitespace_stats, operator_spacing, token_entropy, char_entropy, token_frequencies,
    bigram_perplexity, stored_perplexity, perplexity_readings, naming_stats, identifier_counts, code_structure, feature_table,
    submission_gate, short_text_gate, result_search, annotations_capped, annotation_counts, annotated_source, annotated_code,
    explanations_long, severity_counts, severity_by_feature, feature_report, style_report)}

_BLOCK_COUNTS = " UNION ALL ".join(
    f"SELECT id, '{n}' AS language, {b} AS num_block_comments, {d} AS num_docstrings FROM ({I.TEXTS}) t"
    for n, b, d in (
        [("python", "0::BIGINT", I.count_sql("code", r'"""[\s\S]*?"""|' + r"''''''[\s\S]*?''''''"))]
        + [(n, I.count_sql("code", r"/\*[\s\S]*?\*/"), I.count_sql("code", r"/\*\*[\s\S]*?\*/"))
           for n in ("javascript", "typescript", "java", "c", "cpp")]
        + [("go", I.count_sql("code", r"/\*[\s\S]*?\*/"), "0::BIGINT"),
           ("rust", I.count_sql("code", r"/\*[\s\S]*?\*/"), I.count_sql("code", r"///[^\n]*")),
           ("ruby", I.count_sql("code", r"=begin[\s\S]*?=end"), "0::BIGINT")]))

_SETTINGS = {"python": (0, "#", None, None, 1), "javascript": (1, "//", "/*", "*/", 3), "typescript": (2, "//", "/*", "*/", 1),
             "java": (3, "//", "/*", "*/", 1), "c": (4, "//", "/*", "*/", 2), "cpp": (5, "//", "/*", "*/", 4),
             "go": (6, "//", "/*", "*/", 1), "rust": (7, "//", "/*", "*/", 1), "ruby": (8, "#", "=begin", "=end", 1)}
_SETTINGS_SQL = ", ".join("('" + n + "', " + ", ".join("NULL" if v is None else (str(v) if isinstance(v, int) else f"'{v}'") for v in s) + ")"
                          for n, s in _SETTINGS.items())

_REPORTED = {
    "num_comment_lines": "comments::VARCHAR", "comment_ratio": "comments / total_lines", "avg_comment_length_words": "coalesce(comment_words / nullif(comments, 0), 0)",
    "comment_to_code_ratio": "comment_chars / greatest(length(code), 1)", "total_lines": "total_lines::VARCHAR", "empty_line_ratio": "(total_lines - filled) / total_lines",
    "avg_line_length": "coalesce(chars / nullif(filled, 0), 0)", "max_line_length": "max_line_length::VARCHAR",
    "uses_tabs": "(tabbed > n_lines * 0.1::DOUBLE)::INT::VARCHAR", "trailing_whitespace_ratio": "trail_n / total_lines",
    "operator_spacing_consistency": f"coalesce(greatest({_SPACED}, {_TIGHT}) / nullif({_SPACED} + {_TIGHT}, 0)::DOUBLE, 0)",
}


def _report_sql() -> str:
    names = [(section, name, label) for section, labels in scoring.REPORT.items() for name, label in labels.items()]
    shown = [v if v.endswith("VARCHAR") else f"format('{{:.4f}}', round_even(({v})::DOUBLE, 4))" for v in (_REPORTED.get(name, "'N/A'::VARCHAR") for _, name, _ in names)]
    listed = ", ".join(f"{{'place': {i}::BIGINT, 'section': '{section}', 'label': '{label}', 'shown': {value}}}" for i, ((section, _, label), value) in enumerate(zip(names, shown), 1))
    return f"SELECT id, r.place, r.section, r.label, r.shown FROM (SELECT id, unnest([{listed}]) AS r FROM ({_LINE_SQL}) k) q"


ORACLE = {
    "style_report": _report_sql(),
    "lang_scores": _LANG_SCORES,
    "lang_best": f"SELECT id, {_BEST} AS detected_language FROM ({_LANG_SCORES}) s",
    "lang_by_extension": f"SELECT doc_id AS id, {_EXT_SQL} AS by_extension, regexp_replace(g, '\\.[^.]+\\z', '') AS file_id, "
                         f"regexp_matches(f, '\\.(py|js|java|cpp|ts|go|rs|rb|c|h)$') AS accepted FROM (SELECT doc_id, {_FILE_SQL} AS g, "
                         f"lower({_FILE_SQL}) AS f FROM documents) x",
    "resolved_language": f"SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN 'java' END, CASE WHEN id % 2 = 0 THEN {_EXT_SQL} END, {_BEST}) "
                         f"AS detected_language FROM (SELECT doc_id AS id, lower({_FILE_SQL}) AS f, {_SCORES.replace('(code,', '(text,')} FROM documents) x",
    "unsupported_language": "SELECT doc_id AS id, 'Jezik ''' || lang || ''' nije podržan.' || chr(10) || 'Podržani jezici: c, cpp, go, java, "
                            "javascript, python, ruby, rust, typescript' AS error FROM documents",
    "language_settings": f"SELECT id, best AS language, o::BIGINT AS lang_order, ic AS inline_comment, bo AS block_open, bc AS block_close, "
                         f"ne::BIGINT AS n_extensions FROM (SELECT id, {_BEST} AS best FROM ({_LANG_SCORES}) s) b JOIN (VALUES {_SETTINGS_SQL}) "
                         f"v(best, o, ic, bo, bc, ne) USING (best)",
    "line_stats": f"SELECT id, total_lines, round((total_lines - filled) / total_lines, 6) AS empty_line_ratio, "
                  f"round(coalesce(chars / nullif(filled, 0), 0), 6) AS avg_line_length, max_line_length FROM ({_LINE_SQL}) k",
    "comment_stats": f"SELECT id, comments AS num_comment_lines, round(comments / total_lines, 6) AS comment_ratio, "
                     f"round(coalesce(comment_words / nullif(comments, 0), 0), 6) AS avg_comment_length_words, "
                     f"round(comment_chars / greatest(length(code), 1), 6) AS comment_to_code_ratio FROM ({_LINE_SQL}) k",
    "block_doc_counts": _BLOCK_COUNTS,
    "whitespace_stats": f"SELECT id, (tabbed > n_lines * 0.1::DOUBLE)::BIGINT AS uses_tabs, round(trail_n / total_lines, 6) AS "
                        f"trailing_whitespace_ratio FROM ({_LINE_SQL}) k",
    "operator_spacing": f"SELECT id, {_SPACED} AS spaced, {_TIGHT} AS tight, round(coalesce(greatest({_SPACED}, {_TIGHT}) / "
                        f"nullif({_SPACED} + {_TIGHT}, 0)::DOUBLE, 0), 6) AS operator_spacing_consistency FROM ({I.TEXTS}) t",
    "token_entropy": _entropy_sql(I.DOCUMENTS, f"regexp_extract_all(code, '{I.TOKEN}')", "token_entropy"),
    "char_entropy": _entropy_sql(I.DOCUMENTS, "string_split(code, '')", "char_entropy"),
    "token_frequencies": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{I.TOKEN}')) AS token FROM documents) t GROUP BY token",
    "bigram_perplexity": f"SELECT id, n_pairs, round(perplexity, 6) AS perplexity FROM {_PERPLEXITY} p",
    "stored_perplexity": f"WITH d AS (SELECT regexp_extract_all(code, '{I.TOKEN}') AS t FROM ({I.DOCUMENTS}) x), voc AS (SELECT count(DISTINCT k) AS v FROM "
                         f"(SELECT unnest(t) AS k FROM d)), known AS (SELECT t[i] AS a, t[i + 1] AS b, count(*) AS np FROM (SELECT t, unnest(range(1, len(t))) AS i FROM d) "
                         f"GROUP BY ALL), firsts AS (SELECT a, sum(np) AS nf FROM known GROUP BY a), turns AS (SELECT conv_id || '-' || turn AS id, "
                         f"regexp_extract_all(text, '{I.TOKEN}') AS t FROM conversations), mine AS (SELECT id, t[i] AS a, t[i + 1] AS b FROM (SELECT id, t, "
                         f"unnest(range(1, len(t))) AS i FROM turns)) SELECT id, count(a) AS n_pairs, round(coalesce(exp(-avg(CASE WHEN a IS NOT NULL THEN "
                         f"ln((coalesce(np, 0) + 1.0::DOUBLE) / (coalesce(nf, 0) + v)) END)), -1.0), 6) AS perplexity FROM (SELECT id FROM turns) LEFT JOIN mine USING (id) "
                         f"LEFT JOIN known USING (a, b) LEFT JOIN firsts USING (a), voc GROUP BY id",
    "perplexity_readings": f"SELECT CASE WHEN perplexity < 5 THEN 'vrlo nizak → vjerojatno AI' WHEN perplexity < 20 THEN 'nizak → moguće AI' "
                           f"WHEN perplexity < 60 THEN 'srednji → nejasno' ELSE 'visok → vjerojatno čovjek' END AS reading, count(*) AS n "
                           f"FROM {_PERPLEXITY} p GROUP BY 1",
    "naming_stats": _NAMING,
    "identifier_counts": f"SELECT nm AS name, false AS is_function_name, count(*) AS n FROM {_names_sql()} n GROUP BY nm UNION ALL "
                         f"SELECT nm, true, count(*) FROM {_functions_sql()} f GROUP BY nm",
    "submission_gate": _gate_sql(I.DOCUMENTS, True),
    "short_text_gate": _gate_sql("SELECT conv_id || '-' || turn AS id, text AS code FROM conversations", False),
    "result_search": f"SELECT doc_id AS id, {_FILE_SQL} AS file FROM documents WHERE contains(lower(doc_id::VARCHAR), '7.p') OR "
                     f"contains(lower({_FILE_SQL}), '7.p')",
    "annotations_capped": f"SELECT * FROM {_capped_sql(I.TEXTS, 'python')} c",
    "annotation_counts": f"SELECT t.id, count(*) FILTER (WHERE tone = 'red') AS red, count(*) FILTER (WHERE tone = 'amber') AS amber FROM "
                         f"({I.TEXTS}) t LEFT JOIN {_capped_sql(I.TEXTS, 'python')} c USING (id) GROUP BY t.id",
    "annotated_source": f"SELECT l.id, l.n AS line, l.line AS text, c.tone, c.note FROM {I.lines_sql(I.DOCUMENTS)} l LEFT JOIN "
                        f"{_capped_sql(I.DOCUMENTS, 'java')} c ON l.id = c.id AND l.n = c.line",
    "annotated_code": f"SELECT l.id, l.n AS line, l.line AS text, c.tone, c.note FROM {I.lines_sql(I.CODE)} l LEFT JOIN "
                      f"{_capped_sql(I.CODE, 'java')} c ON l.id = c.id AND l.n = c.line",
    "explanations_long": f"WITH judged AS {_JUDGED} SELECT id, row_number() OVER (PARTITION BY id ORDER BY {_SEVERITY_RANK}, ord) AS rank, "
                         f"severity, feature FROM {_EXPLAINED} e WHERE severity IS NOT NULL",
    "severity_counts": f"WITH judged AS {_JUDGED} SELECT id, count(*) FILTER (WHERE severity = 'high') AS strong, count(*) FILTER (WHERE "
                       f"severity = 'medium') AS moderate, count(*) FILTER (WHERE severity = 'positive') AS human FROM {_EXPLAINED} e GROUP BY id",
    "severity_by_feature": f"WITH judged AS {_JUDGED}, long AS (" + " UNION ALL ".join(
        f"SELECT id, '{n}' AS name, {n}::DOUBLE AS value FROM judged" for n in
        ("comment_ratio", "avg_line_length", "max_line_length", "token_entropy", "empty_line_ratio"))
        + ") SELECT id, name, round(value, 6) AS value, CASE WHEN name = 'comment_ratio' THEN CASE WHEN value > 5 THEN 'high' ELSE 'medium' END "
          "WHEN name = 'token_entropy' THEN 'medium' ELSE 'low' END AS severity_analyze, CASE WHEN contains(name, 'length') AND value > 6 THEN 'high' "
          "WHEN name = 'comment_ratio' AND value > 0.2 THEN 'high' WHEN contains(name, 'entropy') THEN 'medium' ELSE 'low' END AS severity_detail FROM long",
    "feature_report": f"WITH judged AS {_JUDGED} SELECT category, name, severity, count(*) AS n FROM ("
                      "SELECT 'Style' AS category, 'comment_ratio' AS name, CASE WHEN comment_ratio > 0.2 THEN 'high' ELSE 'low' END AS severity FROM judged "
                      "UNION ALL SELECT 'Style', 'trailing_whitespace_ratio', 'low' FROM judged UNION ALL SELECT 'Statistical', 'token_entropy', 'medium' "
                      "FROM judged UNION ALL SELECT 'Statistical', 'perplexity', 'low' FROM judged) r GROUP BY ALL",
}
