"""What a row costs: each expression stands in a plan as often as it is needed."""

import re

from pyspark.sql import functions as F

from authorlens import schemas
from authorlens.catalog.code_texts import TEMPLATES, code_of
from authorlens.functions import annotate, language, style, text
from authorlens.operators import annotations, features, perplexity, scoring


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_of_code_costs_one_template(spark):
    docs = spark.range(40).select("id", F.lit("Some {w} words 12\n\n{n} 3 + {s}\n" * 20).alias("text"))
    made = docs.select("id", code_of(F.col("text"), F.col("id")).alias("code"))
    assert plan_of(made).count("regexp_extract(") == 1
    for r in made.collect():
        kinds = list(TEMPLATES.values())[r.id % 9]
        want = []
        for n, l in enumerate(("Some {w} words 12\n\n{n} 3 + {s}\n" * 20).splitlines(), 1):
            word = (re.search("[A-Za-z]+", l) or re.search("x", "x"))[0].lower()
            parts = {"{w}": word, "{s}": re.sub("[^A-Za-z ]", "", l), "{n}": str(n)}
            want.append(re.sub(r"\{[wsn]\}", lambda m: parts[m[0]], kinds[(n + r.id) % len(kinds)]))
        assert r.code == "\n".join(want) + "\n"


def test_a_border_is_looked_for_behind_its_word(spark):
    pattern = text.regex(r"\bself\b")
    assert pattern.startswith("self")
    codes = ["self", "himself", "self2", "éself", "selfé", "a self.", "himself self", "_self", "(self)"]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select(F.rlike("c", F.lit(pattern)).alias("r")).collect()
    assert [r.r for r in got] == [bool(re.search(r"\bself\b", c)) for c in codes]


def test_values_of_top_features_are_made_once(spark):
    df = spark.createDataFrame([("1", "a b")], "id string, code string")
    df = df.select("id", *[F.length("code").cast("double").alias(c) for c in schemas.MODEL_FEATURES[:3]])
    weights = spark.createDataFrame([(c, 0.1) for c in schemas.MODEL_FEATURES[:3]], "name string, importance double")
    assert not re.search(r"round\((?:try_)?element_at\(map\(", plan_of(scoring.top_features(df, weights)))


def test_pairs_are_kept_as_columns_and_not_as_objects(spark):
    docs = spark.range(20).select("id", F.concat(F.lit("a b c "), "id", F.lit(" a b")).alias("code"))
    plan = perplexity.bigram_perplexity(docs)._jdf.queryExecution().executedPlan().toString()
    model = perplexity.bigram_model(docs)
    assert "ExistingRDD" not in plan
    assert all("ExistingRDD" not in t._jdf.queryExecution().executedPlan().toString() for t in (model.pairs, model.firsts))


def test_tokens_ask_for_unicode_only_behind_plain_letters(spark):
    plain = rf"[a-zA-Z_][{text.WORD}]*+|[0-9]++|[^{text.WORD}{text.WS}]"
    assert text.TOKEN != plain
    odd = ["_a1é²_b $x 12ab é áb  x\x1c\x7f\x00 ٣a a٣ \U0001d400b b\U0001d400 😀! ~`^[]{}\\|\"'#%&@:;<=>?/.-,+*()", "", "a" * 50,
           "".join(map(chr, range(0x300))), "x".join(map(chr, range(0x2000, 0x2070)))]
    df = spark.createDataFrame([(c,) for c in odd], "c string")
    for r in df.select(text.tokens_of(F.col("c")).alias("new"), F.regexp_extract_all("c", F.lit(plain), F.lit(0)).alias("old")).collect():
        assert r.new == r.old


def test_lines_are_cut_by_one_class_and_no_copy_of_the_text(spark):
    odd = ["", "\n", "\r\n", "\r", "a", "a\n", "a\n\n", "a\r\n\r\n", "a\r\r\nb", "\n\r", "a\n\r\nb\r", "x\x0by\x0cz\x1c\x1d\x1ew\x85v u ", "é\r\n😀\n", " \n "]
    df = spark.createDataFrame([(c,) for c in odd], "c string")
    lines = df.select("c", text.lines_of(F.col("c")).alias("l"))
    assert "substring" not in plan_of(lines) and "|" not in text.LINE_END
    assert {r.c: r.l for r in lines.collect()} == {c: c.splitlines() for c in odd}


def test_characters_are_counted_without_sorting_the_text(spark):
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 300))) * 2
    odd = ["", "a", "aaa", "abca é😀é\n\t\x00", "the quick brown fox " * 9, many, many[:255], many[:256], many[:257]]
    df = spark.createDataFrame([(c,) for c in odd], "c string")
    for r in df.select(text.char_entropy(F.col("c")).alias("new"), text.entropy_of(text.chars_of(F.col("c"))).alias("old")).collect():
        assert r.new == r.old
    rows = features.extract_features(spark.createDataFrame([("a", "x")], "id string, code string")).select("char_entropy")
    assert "replace(" in plan_of(rows)


ODD_LINES = ["", " ", "\u3000\x1f\xa0", "# a", "\u2003# b c d e", " \x85// x", "#", "//", "/ /", "a # b", "x\u3000", "x\t", "\u200bx", "é ", "raise ValueError(", "\u3000raise ValueError (x",
             "except (", "\texcept é", "exceptx", "x except (", "throw new Error(", "catch (e", "a: int", "a:\u2003str", "a: intx", ")->\xa0x", ") -> ", ": List", "x : tuple\u3000",
             'alpha "beta\' gamma" delta\'omega', "`alpha` 'bravo charlie", 'say "hello there" charlie delta', "'a \"b' gammas \"delta' epsilon", "éalpha alphaé alpha1 1alpha _alpha alpha_",
             "alphabet\u3000betamax", "\U0001d400alpha alpha\U0001d400 bravo", "return Return RETURN returns alpha", "measured_values of plain_names", "abcd abcde"]


def test_a_border_stands_behind_no_half_of_a_letter(spark):
    codes = ["\U0001d400self", "\U0001f600self", "x \U0001d400self self", "self\U0001d400"]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select(F.rlike("c", F.lit(text.regex(r"\bself\b"))).alias("r")).collect()
    assert [r.r for r in got] == [bool(re.search(r"\bself\b", c)) for c in codes]


def test_rules_that_end_in_a_sign_look_for_it_first(spark):
    ends = [(literals[0], sign) for _, _, literals, patterns in language.CONTENT_RULES for p in patterns for sign in "(<=" if p.endswith(sign)]
    assert len(ends) == 11 and all(first == sign for first, sign in ends)
    codes = ["def f (x", "def f x", "const a\u3000=1", "const a", "template\n<", "vector x", "printf (", "printf", "fn a(", "println!("]
    df = spark.createDataFrame([(c,) for c in codes], "t string").select("t", *[v.alias(n) for n, v in language.content_scores(F.col("t")).items()])
    for r in df.collect():
        assert [r[n] for n in language.NAMES] == [sum(w for langs, w, literals, patterns in language.CONTENT_RULES if n in langs and all(l in r.t for l in literals)
                                                  and all(re.search(p.replace(r"\z", r"\Z"), r.t) for p in patterns)) for n in language.NAMES]


def test_the_beginning_of_a_line_is_read_without_a_pattern(spark):
    df = spark.createDataFrame([(l,) for l in ODD_LINES], "l string")
    line = F.col("l")
    made = df.select("l", text.is_blank(line).alias("blank"), style.is_comment(line, F.lit("python")).alias("hash"),
                     style.is_comment(line, F.lit("java")).alias("slash"), text.ends_in_space(line).alias("tail"))
    assert not re.search("rlike|substring|right\\(", plan_of(made).lower())
    for r in made.collect():
        assert (r.blank, r.hash, r.slash, r.tail) == (not r.l.strip(), r.l.lstrip().startswith("#"), r.l.lstrip().startswith("//"), r.l[-1:].isspace())


def test_a_line_is_marked_without_copies_and_as_before(spark):
    one_text = spark.createDataFrame([("a", "\n".join(ODD_LINES), "python")], "id string, code string, detected_language string")
    marked = annotations.with_annotations(one_text)
    # lines are cut once, in one of two ways
    assert plan_of(marked).count("split(") == 2 and not annotate._LONG_NAME.startswith("(?<!")
    df = spark.createDataFrame([(l,) for l in ODD_LINES], "l string").select("l", annotate.long_names(F.col("l")).alias("n"))
    assert "trim(" not in plan_of(df)
    for r in df.collect():
        bare = r.l.strip()
        for pattern, empty in ((r'"[^"]*"', '""'), (r"'[^']*'", "''"), (r"`[^`]*`", "``")):
            bare = re.sub(pattern, empty, bare)
        assert r.n == [n for n in re.findall(r"(?<!\w)[a-zA-Z_][a-zA-Z0-9_]{4,}(?![a-zA-Z0-9_])(?!\w)", bare) if n.lower() not in annotate.RESERVED]
    notes = {r.line: r.note for r in annotations.annotations(one_text, cap=False).collect()}
    for i, l in enumerate("\n".join(ODD_LINES).splitlines(), 1):
        names = [n for n in re.findall(r"(?<!\w)[a-zA-Z_][a-zA-Z0-9_]{4,}(?!\w)", re.sub("\"[^\"]*\"|'[^']*'|`[^`]*`", "", l)) if n.lower() not in annotate.RESERVED]
        if l.strip() and not l.lstrip().startswith("#") and not names:
            hint = re.search(r"\)\s*->\s*\w|:\s*(?:int|float|str|bool|list|dict|tuple|set|Optional|Union|List|Dict)\b", l.strip())
            raises, handles = re.match(r"\s*(?:raise|throw)\s+\w*(?:Error|Exception)\s*\(", l), re.match(r"\s*(?:except|catch)\s*[(\w]", l)
            assert notes.get(i) == (annotate.TYPE_HINT if hint else annotate.RAISES if raises else annotate.HANDLES if handles else None), l
