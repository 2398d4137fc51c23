"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing extra columns."""

LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "", "en", "s", 0, "x", 1), (2, None, None, None, None, None, None), (None, "one two three four five six", "en", "s", 27, "x", 1),
    (3, "one two three four five six", "en", "s", 27, "x", 1), (3, "one two three four five six", "en", "s", 27, "x", 1),
    (4, LONG, "fr", "t", len(LONG), "x", 2), (5, "   \n\t ", "de", "t", 6, "x", 2), (6, "Ünï 中文 🙂 \x1c \x00 end", "de", "t", 18, "x", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score long"


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
