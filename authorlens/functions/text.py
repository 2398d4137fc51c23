"""Row-local text expressions: lines, tokens, characters, entropies.

Everything here is a Column built from JVM-side functions, so one scan of the
texts yields all of it without a shuffle.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The whitespace and word classes of Unicode-aware matching,
# written out because the default classes of Java regexes are ASCII.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
            "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WORD = r"\p{L}\p{N}_"
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
# single signs and no ranges, and the pair of two behind its first: most places of a text are passed after one look
LINE_END = r"[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"
# The same for texts without the two signs beyond Latin-1: the rest of the class is one table.
LATIN_LINE_END = LINE_END.replace(r"\u2028\u2029", "")
# Plain signs written one by one make a class one table; ranges make it a chain of tests.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = f"{LETTERS}0123456789_"
# Java steps back by halves of characters, unless the look-behind holds a character of two: this one is a letter.
BEHIND = "\U00010400"
# The plain signs of a class stand in front of it alone: the class of Unicode letters is asked only where they end.
WORD_REST = rf"[{PLAIN}]*+[{WORD}]*+"
SIGN = rf"[!-#%-/:-@\[-^`{{-~]|[^{WORD}{WS}]"
TOKEN = rf"[{LETTERS}_]{WORD_REST}|[0-9]++|{SIGN}"


def regex(pattern: str) -> str:
    r"""Give ``\s``, ``\w``, ``\b`` of a short pattern their Unicode meaning in Java.

    Inside a character class write ``{ws}`` or ``{word}`` instead of the escapes.
    """
    # a border stands at either end of a pattern; the one in front is looked for behind the word, which is found fast
    head = re.match(r"\\b(\w+)", pattern)
    if head:
        pattern = f"{head[1]}(?<![{{word}}{BEHIND}]{head[1]}){pattern[head.end():]}"
    pattern = re.sub(r"\\b$", "(?![{word}])", pattern)
    return (pattern.replace("{ws}", WS).replace("{word}", WORD)
            .replace(r"\s", f"[{WS}]").replace(r"\w", f"[{WORD}]"))


_BUILT: WeakKeyDictionary = WeakKeyDictionary()


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """Keep a large expression over named columns: building it takes longer than planning it."""
    def get(*names: str) -> Column:
        built = _BUILT.setdefault(SparkSession.active().sparkContext, {})
        key = (make.__module__, make.__name__, names)
        if key not in built:
            built[key] = make(*[F.col(n) for n in names])
        return built[key]

    return get


def unnest(df: DataFrame, keys: list, array: str, position: str | None = None) -> DataFrame:
    """One row per array element (structs become columns), empty arrays give no row.

    The outer form is used on purpose: the inner form makes the optimizer copy the
    array's whole expression into a filter below the generator.
    """
    if position is None:
        out = df.select(*keys, F.explode_outer(array).alias("_e"))
    else:
        out = df.select(*keys, F.posexplode_outer(array).alias(position, "_e"))
    return out.filter(F.col("_e").isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """Division that gives 0.0 where the divisor is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def how_many(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test)).cast("long")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def lstrip(text: Column) -> Column:
    """Looks no further than the first visible character, on the bytes as they are."""
    return F.ltrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    """True for empty and whitespace-only text."""
    return lstrip(text) == ""


def ends_in_space(line: Column) -> Column:
    return reduce(operator.or_, [F.endswith(line, F.lit(c)) for c in WS_CHARS])


def lines_of(code: Column) -> Column:
    """Lines without terminators; a trailing terminator adds no empty line."""
    def without_last(parts: Column) -> Column:
        n = F.size(parts)
        return F.when(F.get(parts, n - 1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)

    beyond = F.contains(code, F.lit("\u2028")) | F.contains(code, F.lit("\u2029"))
    return let(F.when(beyond, F.split(code, LINE_END, -1)).otherwise(F.split(code, LATIN_LINE_END, -1)), without_last)


def nonblank_lines(code: Column) -> Column:
    return how_many(lines_of(code), lambda l: ~is_blank(l))


def tokens_of(code: Column) -> Column:
    # one blank in front goes with its token, so that most blanks are no place where a token is looked for
    return F.regexp_extract_all(code, F.lit(f" ?+({TOKEN})"), F.lit(1))


def chars_of(code: Column) -> Column:
    return F.when(code == "", F.array().cast("array<string>")).otherwise(F.split(code, "", -1))


def matches(text: Column, pattern: str, must_contain: str | None = None) -> Column:
    """Number of non-overlapping matches; the literal guard skips the regex on most texts."""
    n = F.regexp_count(text, F.lit(pattern)).cast("long")
    return n if must_contain is None else F.when(F.contains(text, F.lit(must_contain)), n).otherwise(F.lit(0).cast("long"))


def run_starts(ordered: Column) -> Column:
    """Positions at which a new value starts in a sorted array."""
    return F.array_compact(F.transform(
        ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i)))


def _entropy(counts: Column, n: Column) -> Column:
    """log2(n) - sum(c * log2(c)) / n, so no per-item probability is formed; 0 for no item."""
    weighted = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
    # greatest() removes the last-bit negative of a one-symbol text
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.greatest(F.log2(n.cast("double")) - weighted / n.cast("double"), F.lit(0.0)))


def entropy_of(items: Column) -> Column:
    """Base-2 entropy of the items of one text, from run lengths of the sorted array."""
    def of_sorted(s: Column) -> Column:
        n = F.size(s)

        def of_starts(starts: Column) -> Column:
            counts = F.transform(starts, lambda p, j: (F.coalesce(F.get(starts, j + 1), n) - p).cast("double"))
            return _entropy(counts, n)

        return let(run_starts(s), of_starts)

    return let(F.sort_array(items), of_sorted)


FEW_CHARS = 256


def char_entropy(code: Column) -> Column:
    """Base-2 entropy of the characters of one text.

    Where there are few different ones, each in turn is taken out of what is left of the text and the loss is its
    count, so the characters themselves are never sorted; other texts go the general way.
    """
    state = "struct<rest:string,counts:array<struct<char:string,n:double>>>"

    def taken(a: Column, x: Column) -> Column:
        def counted(rest: Column) -> Column:
            n = (F.octet_length(a["rest"]) - F.octet_length(rest)).cast("double") / F.octet_length(x).cast("double")
            return F.struct(rest.alias("rest"), F.array_append(a["counts"], F.struct(x.alias("char"), n.alias("n"))).alias("counts")).cast(state)

        return let(F.replace(a["rest"], x, F.lit("")), counted)

    def of_distinct(chars: Column) -> Column:
        zero = F.struct(code.alias("rest"), F.array().alias("counts")).cast(state)
        # in the order of the characters, as sorting would give them: the sum is the same to its last bit
        counts = F.aggregate(chars, zero, taken, lambda a: F.transform(F.sort_array(a["counts"]), lambda c: c["n"]))
        return F.when(F.size(chars) <= FEW_CHARS, _entropy(counts, F.length(code))).otherwise(entropy_of(chars_of(code)))

    return let(F.array_distinct(chars_of(code)), of_distinct)
