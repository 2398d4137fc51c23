"""Perplexity of a text under a bigram model of a corpus.

Stands for the score of a pretrained model: counts of token pairs over the whole
corpus, add-one smoothing, exp of the mean negative log probability.

A fitted model is two relations and a number, kept as tables: the pairs with their log
probabilities, the first tokens with what a pair never seen after them gets, and the size of
the vocabulary.  So texts outside the corpus, and streams, are scored by the same join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from authorlens.functions.text import let, run_starts, tokens_of, unnest
from authorlens.operators.joins import lookup
from authorlens.session import cut_lineage, stored

NO_PAIR = -1.0
ROW = "_row"


@dataclass(frozen=True)
class BigramModel:
    pairs: DataFrame  # (pair, n, log_p)
    firsts: DataFrame  # (first, n_first, unseen): log probability of a new pair that begins with a known token
    vocabulary: int

    @property
    def unknown(self) -> float:
        """Log probability of a pair whose first token is new."""
        return -math.log(max(1, self.vocabulary))

    def save(self, path: str) -> None:
        """Replaces what is under ``path``."""
        self.pairs.select("pair", "n", "log_p").write.mode("overwrite").parquet(f"{path}/pairs")
        self.firsts.select("first", "n_first", "unseen").write.mode("overwrite").parquet(f"{path}/firsts")
        self.pairs.sparkSession.createDataFrame([(self.vocabulary,)], "vocabulary long").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")


def load_model(spark: SparkSession, path: str) -> BigramModel:
    size = spark.read.parquet(f"{path}/vocabulary").first()["vocabulary"]
    return BigramModel(spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/firsts"), size)


def token_counts(df: DataFrame) -> DataFrame:
    """``(token, n)`` over all texts."""
    toks = unnest(df.select("id", tokens_of(F.col("code")).alias("t")), ["id"], "t")
    return toks.groupBy(F.col("_e").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def _row_counts(df: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """``(id, pair, n)`` counted inside each row from the sorted pairs, so nothing is shuffled.

    The last token of a text stands as a pair with nothing: with these rows every token of the
    corpus is the first of some pair, and one tokenisation yields pairs, firsts and vocabulary.
    """
    toks = tokens_of(F.col("code"))
    if max_tokens is not None:
        toks = F.slice(toks, 1, max_tokens)
    pairs = F.transform("t", lambda x, i: F.concat(x, F.lit(" "), F.coalesce(F.get("t", i + 1), F.lit(""))))

    def runs(s):
        return let(run_starts(s), lambda starts: F.transform(starts, lambda p, j: F.struct(
            F.get(s, p).alias("pair"), (F.coalesce(F.get(starts, j + 1), F.size(s)) - p).cast("long").alias("n"))))

    counted = df.select("id", toks.alias("t")).select("id", let(F.sort_array(pairs), runs).alias("p"))
    return unnest(counted, ["id"], "p").select("id", "_e.pair", "_e.n")


def _real(pair: str = "pair"):
    return ~F.endswith(F.col(pair), F.lit(" "))


def text_bigrams(df: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """``(id, pair, n)``: pairs of neighbouring tokens, joined by a space no token contains."""
    return _row_counts(df, max_tokens).where(_real())


def _model_of(counted: DataFrame) -> BigramModel:
    pairs = counted.groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.withColumn("first", F.substring_index("pair", " ", 1)))
    firsts = stored(pairs.groupBy("first").agg(F.sum(F.when(_real(), F.col("n")).otherwise(F.lit(0))).alias("n_first")))
    vocabulary = firsts.count()
    joined = lookup(pairs.where(_real()), firsts.withColumn("w", F.col("n_first")), "first", "n_first", "w", "pair")
    log_p = F.ln((F.col("n") + 1.0) / (F.col("n_first") + vocabulary))
    unseen = F.ln(1.0 / (F.col("n_first") + float(vocabulary)))
    return BigramModel(stored(joined.select("pair", "n", log_p.alias("log_p"))), firsts.select("first", "n_first", unseen.alias("unseen")), vocabulary)


def bigram_model(df: DataFrame, max_tokens: int | None = None) -> BigramModel:
    """Pairs with log p = ln((n + 1) / (n_first + V)); a text without a token adds nothing, and a corpus without one is a model of none.

    The counts and the model are written to the checkpoint folder, as each is read several times.
    """
    return _model_of(_row_counts(df, max_tokens))


def _log_p(counted: DataFrame, model: BigramModel) -> DataFrame:
    """``counted`` with ``log_p``, from a model of another corpus.

    The batch's own pairs and first tokens, once each, pick their rows from the stored tables:
    where they are few they are broadcast (adaptive execution checks their size) and the tables
    are read, not shuffled.
    """
    mine = stored(counted.groupBy("pair").agg(F.sum("n").alias("w")).withColumn("first", F.substring_index("pair", " ", 1)))
    seen = model.pairs.select("pair", "log_p").join(mine.select("pair"), "pair", "left_semi")
    heads = model.firsts.select("first", "unseen").join(mine.select("first").distinct(), "first", "left_semi")
    weights = mine.groupBy("first").agg(F.sum("w").alias("w"))
    known = lookup(mine.join(seen, "pair", "left"), heads.join(weights, "first"), "first", "unseen", "w", "pair")
    found = stored(known.select("pair", "w", F.coalesce("log_p", "unseen", F.lit(model.unknown)).alias("log_p")))
    return lookup(counted, found, "pair", "log_p", "w", "id")


def bigram_perplexity(df: DataFrame, max_tokens: int | None = None, model: BigramModel | None = None) -> DataFrame:
    """``(id, n_pairs, perplexity)``; -1.0 for texts without a pair.

    The model is that of ``df`` itself, or a given one.  Whole texts by default; ``max_tokens=512``
    gives the window of the original scorer.  Rows of one id count as one text, so give rows a key
    of their own where ids repeat.
    """
    counted = stored(_row_counts(df, max_tokens))
    real = counted.where(_real())
    if model is None:
        scored = lookup(real, _model_of(counted).pairs, "pair", "log_p", "n", "id")
    else:
        scored = _log_p(real, model)
    per_text = scored.groupBy("id").agg(F.sum("n").alias("n_pairs"),
                                        F.sum(F.col("n") * F.col("log_p")).alias("_l"))
    return df.select("id").join(per_text, "id", "left").select(
        "id", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
        F.coalesce(F.exp(-F.col("_l") / F.col("n_pairs")), F.lit(NO_PAIR)).alias("perplexity"))


# ------------------------------------------------------------------ beside other columns of a row

def row_place() -> Column:
    """A key for each row of a table of files: the file and the place in it.  Texts need not be written or numbered for it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` with a key per row, written to the checkpoint folder so that it stays; for rows that come from no file with places."""
    return df if ROW in df.columns else cut_lineage(df.withColumn(ROW, F.monotonically_increasing_id()))


def row_perplexity(df: DataFrame, model: BigramModel | None = None) -> DataFrame:
    """``(_row, perplexity)`` of every row of ``df``, which has ``_row`` and ``code``; the texts stay where they are."""
    scored = bigram_perplexity(df.select(F.col(ROW).alias("id"), "code"), model=model)
    return scored.select(F.col("id").alias(ROW), "perplexity")


def attach_perplexity(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Feature rows with ``_row`` get the perplexity of their text; a row in error keeps none."""
    found = rows.drop("perplexity").join(scored, ROW, "left")
    ok = F.col("error").isNull()
    return found.withColumns({"perplexity": F.when(ok, F.coalesce("perplexity", F.lit(NO_PAIR))),
                              "model_available": F.when(ok, F.lit(1)).cast("long")})


def with_perplexity(df: DataFrame, name: str = "_ppl", model: BigramModel | None = None) -> DataFrame:
    """``df`` with the perplexity of each text as a column; null and repeated ids neither vanish nor multiply.

    The whole rows are joined.  For features, ``row_perplexity`` and ``attach_perplexity`` move no texts.
    """
    df = with_row_key(df)
    return df.join(row_perplexity(df, model).withColumnRenamed("perplexity", name), ROW).drop(ROW)
