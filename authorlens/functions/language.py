"""Language configuration and detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from authorlens.functions.text import regex

# One entry per supported language, in the order that breaks ties.
# (name, extensions, comment mark, block comment marks, documentation pattern, text it must contain)
LANGUAGES = [
    ("python", [".py"], "#", None, r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'', None),
    ("javascript", [".js", ".mjs", ".cjs"], "//", ("/*", "*/"), r"/\*\*[\s\S]*?\*/", "/**"),
    ("typescript", [".ts"], "//", ("/*", "*/"), r"/\*\*[\s\S]*?\*/", "/**"),
    ("java", [".java"], "//", ("/*", "*/"), r"/\*\*[\s\S]*?\*/", "/**"),
    ("c", [".c", ".h"], "//", ("/*", "*/"), r"/\*\*[\s\S]*?\*/", "/**"),
    ("cpp", [".cpp", ".cc", ".cxx", ".hpp"], "//", ("/*", "*/"), r"/\*\*[\s\S]*?\*/", "/**"),
    ("go", [".go"], "//", ("/*", "*/"), None, None),
    ("rust", [".rs"], "//", ("/*", "*/"), r"///[^\n]*", "///"),
    ("ruby", [".rb"], "#", ("=begin", "=end"), None, None),
]
NAMES = [l[0] for l in LANGUAGES]
HASH_COMMENT = [l[0] for l in LANGUAGES if l[2] == "#"]
DEFAULT = "python"

# Content rules as (languages, weight, literals the text must contain, patterns).
# A rule scores when all of its patterns are found.  The rarest literal stands first: a sign that many rules
# share is looked for once, and a text without it is passed by all of them.
CONTENT_RULES = [
    (["python"], 3, ["(", "def"], [r"\bdef\s+\w+\s*\("]),
    (["python"], 2, ['"""'], []),
    (["python"], 2, ["self"], [r"\bself\b"]),
    (["python"], 1, ["(", "print"], [r"\bprint\s*\("]),
    (["python"], 1, [":"], [r":\s*(?:\n|\z)"]),
    (["java"], 4, ["public", "class"], [r"\bpublic\s+class\b"]),
    (["java"], 3, ["System.out"], [r"\bSystem\.out\b"]),
    (["java"], 2, ["public", "static"], [r"\bpublic\s+static\b"]),
    (["java"], 2, ["void", "main"], [r"\bvoid\s+main\b"]),
    (["javascript"], 2, ["=", "const"], [r"\bconst\s+\w+\s*="]),
    (["javascript"], 3, ["=>"], [r"=>\s*[{(]"]),
    (["javascript"], 3, ["console.log"], [r"\bconsole\.log\b"]),
    (["typescript"], 4, [":"], [r":\s*(?:string|number|boolean|void)\b"]),
    (["typescript"], 4, ["interface"], [r"\binterface\s+\w+"]),
    (["c", "cpp"], 3, ["#include"], [r'#include\s*[<"]']),
    (["cpp"], 4, [":", "std::"], [r"\bstd::"]),
    (["cpp"], 4, ["cout"], [r"\bcout\b"]),
    (["cpp"], 4, ["cin"], [r"\bcin\b"]),
    (["cpp"], 4, ["using", "namespace"], [r"\busing\s+namespace\b"]),
    (["cpp"], 3, ["<", "template"], [r"\btemplate\s*<"]),
    (["cpp"], 3, ["<", "vector"], [r"\bvector\s*<"]),
    (["cpp"], 2, ["#include", "string"], [r"\bstring\b"]),
    (["c"], 3, ["(", "printf"], [r"\bprintf\s*\("]),
    (["c"], 3, ["(", "scanf"], [r"\bscanf\s*\("]),
    (["c"], 3, ["(", "malloc"], [r"\bmalloc\s*\("]),
    (["go"], 4, ["(", "func"], [r"\bfunc\s+\w+\s*\("]),
    (["go"], 4, ["package"], [r"\bpackage\s+\w+"]),
    (["go"], 3, ["fmt.Print"], [r"\bfmt\.Print"]),
    (["rust"], 4, ["(", "fn"], [r"\bfn\s+\w+\s*\("]),
    (["rust"], 4, ["let", "mut"], [r"\blet\s+mut\b"]),
    (["rust"], 3, ["(", "println!"], [r"\bprintln!\s*\("]),
    (["ruby"], 3, ["def", "end"], [r"\bdef\s+\w+", r"\bend\b"]),
    (["ruby"], 3, ["puts"], [r"\bputs\s+"]),
]

UNSUPPORTED_TEXT = "Jezik '%s' nije podržan.\nPodržani jezici: " + ", ".join(sorted(NAMES))


def config_table(spark: SparkSession) -> DataFrame:
    """The language dimension as a table users can extend with ``unionByName``."""
    rows = [(n, i, ext, mark, blk[0] if blk else None, blk[1] if blk else None, doc)
            for i, (n, ext, mark, blk, doc, _) in enumerate(LANGUAGES)]
    return spark.createDataFrame(
        rows, "language string, lang_order int, extensions array<string>, inline_comment string, "
              "block_open string, block_close string, docstring_pattern string")


def attach_config(df: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Left join with the (few-row) language table; unknown languages get nulls."""
    config = config_table(df.sparkSession) if config is None else config
    key = F.lower(F.trim(F.col("language")))
    return (df.withColumn("_k", key)
            .join(F.broadcast(config.withColumnRenamed("language", "_k")), "_k", "left").drop("_k"))


def by_extension(filename: Column) -> Column:
    """Language of a file name, null when no extension is known."""
    name = F.lower(filename)
    hits = [F.when(reduce(lambda a, b: a | b, [F.endswith(name, F.lit(e)) for e in ext]), F.lit(lang))
            for lang, ext, *_ in LANGUAGES]
    return F.coalesce(*hits)


def content_scores(code: Column) -> dict[str, Column]:
    """Rule score per language."""
    scores: dict[str, list[Column]] = {n: [] for n in NAMES}
    for langs, weight, literals, patterns in CONTENT_RULES:
        tests = [F.contains(code, F.lit(x)) for x in literals] + [F.rlike(code, F.lit(regex(p))) for p in patterns]
        points = F.when(reduce(lambda a, b: a & b, tests), F.lit(weight)).otherwise(F.lit(0))
        for lang in langs:
            scores[lang].append(points)
    return {n: reduce(lambda a, b: a + b, s).cast("long") for n, s in scores.items()}


def best_language(scores: dict[str, Column]) -> Column:
    """Highest score, earlier language on a tie, the default when nothing scored."""
    ranked = F.array_max(F.array(*[
        F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("name"))
        for i, (n, s) in enumerate(scores.items())]))
    return F.when(ranked["score"] > 0, ranked["name"]).otherwise(F.lit(DEFAULT))


def by_content(code: Column) -> Column:
    return best_language(content_scores(code))


def resolve(content: Column, language: Column | None = None, filename: Column | None = None) -> Column:
    """Given language, else extension, else the one by content; later steps run only where needed."""
    steps = []
    if language is not None:
        steps.append(F.lower(language))
    if filename is not None:
        steps.append(by_extension(filename))
    return F.coalesce(*steps, content)


def is_supported(language: Column) -> Column:
    return F.trim(language).isin(NAMES)


def unsupported_error(language: Column) -> Column:
    """Error text of a language without configuration, else null."""
    return F.when(language.isNotNull() & ~is_supported(F.lower(language)),
                  F.format_string(UNSUPPORTED_TEXT, language))
