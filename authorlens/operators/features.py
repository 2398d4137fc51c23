"""Submissions -> feature rows.  Narrow: one scan, no shuffle, any text length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from authorlens import schemas
from authorlens.functions import language as lang
from authorlens.functions import naming, structure, style, text


_lex = text.built_once(structure.lex)
_roles = text.built_once(structure.role_map)
_shape = text.built_once(structure.shape)
_classified = text.built_once(structure.classified)
_arguments = text.built_once(structure.argument_counts)
_by_content = text.built_once(lang.by_content)


def with_language(df: DataFrame) -> DataFrame:
    """Adds ``detected_language`` by the order given language, extension, content."""
    cols = df.columns
    given = F.col("language") if "language" in cols else None
    name = None
    if "filename" in cols and "file" in cols:
        name = F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.col("file"))
    elif "filename" in cols:
        name = F.col("filename")
    # a language is lower-cased here once, so every later rule sees the same spelling
    return df.withColumn("detected_language", F.trim(lang.resolve(_by_content("code"), given, name)))


def with_lines(df: DataFrame) -> DataFrame:
    df = df.withColumn("_lines", text.lines_of(F.col("code")))
    df = df.withColumn("_filled", F.filter("_lines", lambda l: ~text.is_blank(l)))
    return df.withColumn("_comments", style.comment_lines(F.col("_filled"), F.col("detected_language")))


def style_features(df: DataFrame) -> DataFrame:
    """Line and comment features; needs ``code`` and ``detected_language``."""
    code, language, lines = F.col("code"), F.col("detected_language"), F.col("_lines")
    if "_lines" not in df.columns:
        df = with_lines(df)
    counted = df.withColumns({
        **style.comment_counts(F.col("_comments"), language),
        **style.line_counts(lines, F.col("_filled")),
        **style.operator_counts(code),
    })
    return counted.withColumns(
        {**style.comment_features(code, language), **style.line_features(), **style.operator_features()})


def with_shape(df: DataFrame) -> DataFrame:
    """Adds the token array, the constructs and the names of each text."""
    df = df.withColumns({"_tokens": _lex("code", "detected_language"), "_roles": _roles("detected_language")})
    df = df.withColumns({
        "_shape": _shape("_tokens", "_roles", "detected_language"),
        "_classified": _classified("_tokens"),
    })
    return df.withColumns({
        "_blocks": structure.blocks_of(F.col("_shape")),
        "_names": structure.identifiers(F.col("_classified")),
        "_kinds": structure.token_kinds(F.col("_classified")),
        "_args": _arguments("code", "detected_language"),
    })


def naming_features(df: DataFrame) -> DataFrame:
    if "_blocks" not in df.columns:
        df = with_shape(df)
    names = F.when(F.col("detected_language").isin(structure.NAMED_FUNCTION),
                   structure.function_names(F.col("_blocks"))).otherwise(F.array().cast("array<string>"))
    counted = df.withColumn("_functions", names).withColumns(
        naming.naming_counts(F.col("_names"), F.col("_functions")))
    return counted.withColumns(naming.naming_features())


def structure_features(df: DataFrame) -> DataFrame:
    if "_blocks" not in df.columns:
        df = with_shape(df)
    if "_filled" not in df.columns:
        df = with_lines(df)
    counted = df.withColumns(structure.structure_counts(
        F.col("_blocks"), F.col("_classified"), F.col("_args"), F.col("detected_language")))
    return counted.withColumns(structure.structure_features(
        F.col("_shape")["deep"], F.size("_filled").cast("long")))


def entropy_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "char_entropy": text.char_entropy(F.col("code")),
        "token_entropy": text.entropy_of(text.tokens_of(F.col("code"))),
    })


def extract_features(df: DataFrame, perplexity: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """All features in contract order.

    ``df`` has ``id`` and ``code`` and may have ``language``, ``filename``, ``file``.
    Without a ``perplexity`` column the value is -1.0 and ``model_available`` is 0.
    A text in an unsupported language becomes a row with ``error`` and null features.
    Columns named in ``keep`` are passed on.
    """
    if perplexity is None:
        statistical = {"perplexity": F.lit(-1.0), "model_available": F.lit(0).cast("long")}
    else:
        statistical = {"perplexity": F.coalesce(perplexity, F.lit(-1.0)), "model_available": F.lit(1).cast("long")}
    out = with_language(df)
    out = out.withColumn("error", lang.unsupported_error(F.col("detected_language")))
    # a failed row carries no text into the expensive expressions
    out = out.withColumn("code", F.when(F.col("error").isNull(), F.coalesce(F.col("code"), F.lit(""))))
    out = entropy_features(structure_features(naming_features(style_features(with_lines(out)))))
    out = out.withColumns(statistical)
    ok = F.col("error").isNull()
    cast = [F.when(ok, F.col(c)).cast(schemas.feature_type(c)).alias(c) for c in schemas.FEATURES]
    return out.select(*[c for c in (keep or ["id"])], "detected_language", *cast, "error")


def identifiers(df: DataFrame) -> DataFrame:
    """Relation ``(id, pos, name, is_function_name)``, positions from 1 per kind."""
    df = naming_features(df if "detected_language" in df.columns else with_language(df))

    def rows(column: str, flag: bool) -> DataFrame:
        return text.unnest(df, ["id"], column, "pos").select(
            "id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("_e").alias("name"),
            F.lit(flag).alias("is_function_name"))

    return rows("_names", False).unionByName(rows("_functions", True))


def code_blocks(df: DataFrame) -> DataFrame:
    """Relation ``(id, node_id, role, depth, start, finish, name, opened, closed)`` of the constructs of each text."""
    df = with_shape(df if "detected_language" in df.columns else with_language(df))
    return text.unnest(df, ["id"], "_blocks", "node_id").select(
        "id", F.col("node_id").cast("long").alias("node_id"), "_e.*")
