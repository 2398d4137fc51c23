"""How the given tables stand for submissions, samples and predictions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from authorlens.catalog.code_texts import code_sql, code_texts
from authorlens.operators.perplexity import ROW, row_place
from authorlens.session import dealt


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, busy: bool = False, placed: bool = False) -> DataFrame:
    """``busy`` deals the rows out for queries that do heavy work on each text; ``placed`` adds a key per row."""
    key = [row_place().alias(ROW)] if placed else []
    d = table(spark, sf, "documents").select("doc_id", "text", "source", "lang", *key)
    d = dealt(d) if busy else d
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("code"), "source", "lang", *([ROW] if placed else []))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("code"), "url")


def code(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a text of code."""
    return code_texts(documents(spark, sf, busy=True))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Prose, markup and code together; ids say where a text is from."""
    d = documents(spark, sf)
    named = lambda rows, mark: rows.select(F.concat(F.lit(mark), F.col("id").cast("string")).alias("id"), "code")
    return dealt(named(d, "d").unionByName(named(pages(spark, sf), "p")).unionByName(named(code_texts(d), "c")))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Quality 0 plays the machine-made class."""
    return table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("label"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents."""
    return documents(spark, sf).join(labels(spark, sf), "id")


def probability(code, modulus: int = 1009):
    """A repeatable stand-in for a model's probability, used to feed the rules in checks."""
    n = F.length(code)
    return F.when(n % 17 != 0, (n % modulus) / F.lit(float(modulus)))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    s = samples(spark, sf)
    return s.select("id", F.col("label").alias("y_true"), ((F.length("code") % 211) / F.lit(211.0)).alias("p"), "source")


# ------------------------------------------------------------------ the same in SQL

# Whitespace and word classes in the other engine's notation.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TOKEN = rf"[a-zA-Z_][{WORD}]*|[0-9]+|[^{WORD}{WS}]"

DOCUMENTS = "SELECT doc_id AS id, text AS code, source, lang FROM documents"
PAGES = "SELECT page_id AS id, html AS code, url FROM pages"
SAMPLES = ("SELECT d.doc_id AS id, d.text AS code, d.source, 1 - l.quality AS label "
           "FROM documents d JOIN labels l USING (doc_id)")
PREDICTIONS = ("SELECT d.doc_id AS id, 1 - l.quality AS y_true, (length(d.text) % 211) / 211.0::DOUBLE AS p, d.source "
               "FROM documents d JOIN labels l USING (doc_id)")
PROBABILITY = "CASE WHEN length(code) % 17 <> 0 THEN (length(code) % 1009) / 1009.0::DOUBLE END"


def lines_sql(source: str) -> str:
    """Subquery ``(id, n, line)`` numbered from 1."""
    return (f"(SELECT id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT id, CASE WHEN code = '' "
            f"THEN []::VARCHAR[] ELSE regexp_split_to_array(regexp_replace(code, '({LINE_END})\\z', ''), '{LINE_END}') "
            f"END AS ls FROM ({source}) src0) src1)")


CODE = f"SELECT id, code FROM {code_sql(lines_sql(DOCUMENTS))} code0"
TEXTS = ("SELECT 'd' || doc_id AS id, text AS code FROM documents UNION ALL SELECT 'p' || page_id AS id, html AS code FROM pages "
         f"UNION ALL SELECT 'c' || id AS id, code FROM ({CODE}) code1")


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+\\z', '')"


def count_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))::BIGINT"
