"""Row-local text functions against plain Python restatements."""

import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from authorlens.functions import language, style, text
from authorlens.operators import features
from tests.snippets import NEAR_A, NEAR_B

ALPHABET = "ab_Z9é𝒳 \t\n\r\x0b\x0c\x1c\x85  =!<>#/'\"()"


def texts():
    return st.text(alphabet=ALPHABET, max_size=40)


def rows(spark, codes):
    return spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id int, code string")


def entropy(items):
    n = len(items)
    return -sum(c / n * math.log2(c / n) for c in Counter(items).values()) if n else 0.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(texts(), min_size=30, max_size=30))
def test_lines_tokens_and_counts_equal_python(spark, codes):
    codes = codes + ["", "\n", "a\r\nb\x0cc\x1cd\n", "  ", "\r\n\r\n", "a == b!=c =  = d", "x==y==z = = q"]
    code = F.col("code")
    got = rows(spark, codes).withColumns(style.operator_counts(code)).select(
        "id", text.lines_of(code).alias("lines"), text.tokens_of(code).alias("tokens"), text.strip(code).alias("strip"),
        text.nonblank_lines(code).alias("filled"), text.entropy_of(text.chars_of(code)).alias("hc"),
        text.entropy_of(text.tokens_of(code)).alias("ht"), "_spaced", "_tight").collect()
    for r in got:
        c = codes[r.id]
        assert r.lines == c.splitlines()
        assert r.strip == c.strip()
        assert r.filled == sum(1 for l in c.splitlines() if l.strip())
        tokens = re.findall(r"[a-zA-Z_]\w*|[0-9]+|[^\w\s]", c)
        assert r.tokens == tokens
        assert r.hc == pytest.approx(entropy(c), abs=1e-9)
        assert r.ht == pytest.approx(entropy(tokens), abs=1e-9)
        assert r._spaced == len(re.findall(r"\s[=!<>]=?\s", c))
        assert r._tight == len(re.findall(r"[^\s=!<>][=!<>]=[^\s=]", c))


# Counted by hand: text, its lines in any language, its comments under "#" and under "//".
LINES = ["total_lines", "empty_line_ratio", "avg_line_length", "max_line_length", "uses_tabs", "trailing_whitespace_ratio"]
COMMENTS = ["num_comment_lines", "comment_ratio", "avg_comment_length_words", "comment_to_code_ratio"]
NO_COMMENT = (0, 0, 0, 0)
BY_HAND = [
    ("", (1, 1, 0, 0, 0, 0), NO_COMMENT, NO_COMMENT),
    ("\n\n", (2, 1, 0, 0, 0, 0), NO_COMMENT, NO_COMMENT),
    ("\t# a b\n#c \n\n  // d", (4, 1 / 4, 5, 6, 1, 1 / 4), (2, 1 / 2, 1.5, 9 / 18), (1, 1 / 4, 1, 6 / 18)),
    ("x = 1  \r\n\r\n    # six words are in this one\r\ny = 2 # not a line of comment", (4, 1 / 4, 67 / 3, 31, 0, 1 / 4),
     (1, 1 / 4, 6, 31 / 73), NO_COMMENT),
    ("//a\n// b c\nint x; // d\t\n\tz", (4, 0, 23 / 4, 12, 1, 1 / 4), NO_COMMENT, (2, 1 / 2, 1.5, 9 / 26)),
    ("\u2003# wide blank\x85\x1cé é \u2029#", (4, 1 / 4, 18 / 3, 13, 0, 1 / 4), (2, 1 / 2, 1, 14 / 21), NO_COMMENT),
]


@pytest.mark.parametrize("lang,mark", [("python", 2), ("ruby", 2), ("java", 3), ("rust", 3)])
def test_style_features_by_hand(spark, lang, mark):
    df = rows(spark, [case[0] for case in BY_HAND]).withColumn("detected_language", F.lit(lang))
    for r in features.style_features(features.with_lines(df)).collect():
        want = dict(zip(LINES, BY_HAND[r.id][1])) | dict(zip(COMMENTS, BY_HAND[r.id][mark]))
        assert {k: r[k] for k in want} == {k: pytest.approx(v) for k, v in want.items()}, BY_HAND[r.id][0]


def test_golden_pair(spark):
    got = {r.id: r for r in features.extract_features(spark.createDataFrame(
        [("a", NEAR_A, "python"), ("b", NEAR_B, "Python"), ("e", "", "python"), ("x", "y = 1", "cobol")],
        "id string, code string, language string")).collect()}
    want = {
        "a": dict(total_lines=9, num_comment_lines=1, comment_ratio=0.111111, avg_comment_length_words=6.0,
                  empty_line_ratio=0.222222, avg_line_length=29.571429, max_line_length=41, uses_tabs=0,
                  trailing_whitespace_ratio=0, num_docstrings=0, num_block_comments=0, token_entropy=4.918089, char_entropy=4.404783),
        "b": dict(total_lines=9, num_comment_lines=1, comment_ratio=0.111111, avg_comment_length_words=8.0,
                  empty_line_ratio=0.222222, avg_line_length=31.0, max_line_length=47, token_entropy=5.051109, char_entropy=4.483513),
        "e": dict(total_lines=1, empty_line_ratio=1.0, max_line_length=0, token_entropy=0, char_entropy=0),
    }
    for i, values in want.items():
        for k, v in values.items():
            assert got[i][k] == pytest.approx(v, abs=1e-6), (i, k)
    assert got["x"].error.startswith("Jezik 'cobol' nije podržan") and got["x"].total_lines is None
    assert got["a"].error is None and got["b"].detected_language == "python"


@pytest.mark.parametrize("name,lang", [("A.H", "c"), ("x.mjs", "javascript"), ("x.hpp", "cpp"), ("x.txt", None), ("a.c", "c")])
def test_extension(spark, name, lang):
    assert spark.range(1).select(language.by_extension(F.lit(name))).first()[0] == lang


def test_content_language(spark):
    cases = {"": "python", "hello": "python", "#include <x>": "c", "#include <x>\nstd::string s;": "cpp",
             "package main\nfunc f() {}": "go", "fn main() { let mut x = 1; }": "rust", "def a\nend": "ruby",
             "public class A {}": "java", "const x = 1; console.log(x)": "javascript", "interface Foo {}": "typescript",
             "def f(x):\n  return self": "python", "xdef f(": "python"}
    df = spark.createDataFrame(list(cases.items()), "code string, want string")
    for r in df.select("code", "want", language.by_content(F.col("code")).alias("got")).collect():
        assert r.got == r.want, r.code


def test_naming_predicates(spark):
    from authorlens.functions import naming
    names = ["snake_a", "_x_y", "camelCase", "Pascal", "ABC", "x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(naming.is_snake(F.col("n")), naming.is_camel(F.col("n")), naming.is_pascal(F.col("n"))).collect()]
    assert got == [(True, False, False), (False,) * 3, (False, True, False), (False, False, True), (False,) * 3, (False,) * 3]
