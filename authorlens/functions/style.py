"""Line-level style features; every input is a column of the current row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from authorlens.functions.language import HASH_COMMENT, LANGUAGES
from authorlens.functions.text import WS, ends_in_space, how_many, is_blank, lstrip, matches, ratio, total

C_STYLE_BLOCK = r"/\*[\s\S]*?\*/"
RUBY_BLOCK = r"=begin[\s\S]*?=end"
# The sign comes first and the look-behind checks what precedes it: a four-sign
# class rejects almost every position at once.  The signs swallowed at the end keep
# the count of matches that consume the preceding character too.
SPACED_OPERATOR = rf"[=!<>](?<=[{WS}][=!<>])=?[{WS}][=!<>]*+"
TIGHT_OPERATOR = rf"[=!<>](?<=[^{WS}=!<>][=!<>])=[^{WS}=][=!<>]*+"


def is_comment(line: Column, language: Column) -> Column:
    return F.startswith(lstrip(line), F.when(language.isin(HASH_COMMENT), F.lit("#")).otherwise(F.lit("//")))


def comment_text(line: Column, language: Column) -> Column:
    """Comment line without its first mark."""
    return (F.when(language.isin(HASH_COMMENT), F.regexp_replace(line, rf"\A[{WS}]*+#", ""))
            .otherwise(F.regexp_replace(line, rf"\A[{WS}]*+//", "")))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{WS}]+")).cast("long")


def block_comments(code: Column, language: Column) -> Column:
    none = F.lit(0).cast("long")
    return (F.when(language == "python", none)
            .when(language == "ruby", matches(code, RUBY_BLOCK, "=begin"))
            .otherwise(matches(code, C_STYLE_BLOCK, "/*")))


def docstrings(code: Column, language: Column) -> Column:
    out = F.lit(0).cast("long")
    for name, *_, pattern, literal in LANGUAGES:
        if pattern:
            out = F.when(language == name, matches(code, pattern, literal)).otherwise(out)
    return out


# Counts are columns of their own and features refer to them: Spark does not share
# higher-order functions between expressions of one projection.

def line_counts(lines: Column, filled: Column) -> dict[str, Column]:
    """``lines`` are all lines of a text and ``filled`` the non-blank ones."""
    lengths = F.transform(filled, F.length)
    return {
        "_n_lines": F.size(lines).cast("long"),
        "_n_filled": F.size(filled).cast("long"),
        "_len_sum": total(lengths),
        "_len_max": F.array_max(lengths),
        "_n_tabbed": how_many(lines, lambda l: F.startswith(l, F.lit("\t"))),
        "_n_trailing": how_many(lines, ends_in_space),
    }


def line_features() -> dict[str, Column]:
    n, filled = F.col("_n_lines"), F.col("_n_filled")
    n_total = F.greatest(n, F.lit(1).cast("long"))
    return {
        "total_lines": n_total,
        "empty_line_ratio": ratio(n_total - filled, n_total),
        "avg_line_length": ratio(F.col("_len_sum"), filled),
        "max_line_length": F.coalesce(F.col("_len_max"), F.lit(0)).cast("long"),
        "uses_tabs": (F.col("_n_tabbed") > n.cast("double") * 0.1).cast("long"),
        "trailing_whitespace_ratio": ratio(F.col("_n_trailing"), n_total),
    }


def comment_lines(filled: Column, language: Column) -> Column:
    return F.filter(filled, lambda l: is_comment(l, language))


def comment_counts(comments: Column, language: Column) -> dict[str, Column]:
    words = F.transform(comments, lambda l: word_count(comment_text(l, language)))
    return {
        "_n_comments": F.size(comments).cast("long"),
        "_comment_words": total(words),
        "_comment_chars": total(F.transform(comments, F.length)),
    }


def comment_features(code: Column, language: Column) -> dict[str, Column]:
    n = F.col("_n_comments")
    return {
        "num_comment_lines": n,
        "comment_ratio": ratio(n, F.greatest(F.col("_n_lines"), F.lit(1))),
        "avg_comment_length_words": ratio(F.col("_comment_words"), n),
        "comment_to_code_ratio": ratio(F.col("_comment_chars"), F.greatest(F.length(code), F.lit(1))),
        "num_block_comments": block_comments(code, language),
        "num_docstrings": docstrings(code, language),
    }


def operator_counts(code: Column) -> dict[str, Column]:
    return {"_spaced": matches(code, SPACED_OPERATOR), "_tight": matches(code, TIGHT_OPERATOR, "=")}


def operator_features() -> dict[str, Column]:
    spaced, tight = F.col("_spaced"), F.col("_tight")
    return {"operator_spacing_consistency": ratio(F.greatest(spaced, tight), spaced + tight)}
