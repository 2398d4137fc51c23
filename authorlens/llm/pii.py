"""Personal data with DataFrame functions only: patterns propose, checksums confirm, context scores.

Positions come from one split and one extraction per kind: the start of a match is the sum of
all gaps and matches before it.  The patterns differ from the base ones only in look-behinds
and possessive quantifiers that change no match but keep each scan linear.

Rows stay rows (repeated ids, null ids); a null text is empty; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # as Java runs it
    plain: str  # the base pattern
    needs: str | None  # a literal every match holds
    prior: float
    context: str  # whole words on either side that raise the score
    base: bool = True


# Patterns, priors and context words.
EMAIL = Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
             r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@", 0.8, "mail|email|contact|write|correo|courriel")
IP = Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", ".", 0.5,
          "ip|host|server|address|login|client")
CARD = Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9])+", None, 0.7, "card|visa|mastercard|credit|karte|carte|tarjeta")
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|telephone|tel|call|mobile|fax|whatsapp")
IBAN = Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
            r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", None, 0.8, "iban|account|bank|konto|compte|cuenta", base=False)
KINDS = (EMAIL, IP, CARD, PHONE, IBAN)
AGAINST = "example|version|sample|isbn|order|invoice|dummy"
REACH = 40  # characters of context on either side of a match
STEP = 0.2
LIKELY = 0.5


def running_sums(lengths: Column) -> Column:
    """Sums of all elements before each one; blocks keep the copying linear.

    ``lengths`` must be a plain column: it is read inside lambdas.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                         lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK)))
    grow = lambda xs, value: F.aggregate(
        xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + value(x))))
    inner = F.transform(blocks, lambda b: grow(b, lambda x: x))
    firsts = grow(inner, lambda b: F.element_at(b, -1))
    both = F.filter(F.arrays_zip(inner.alias("b"), firsts.alias("f")), lambda z: z["b"].isNotNull())  # firsts ends with the total
    return F.flatten(F.transform(both, lambda z: F.transform(F.slice(z["b"], 1, F.size(z["b"]) - 1), lambda x: x + z["f"])))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def mod97(code: Column) -> Column:
    """Remainder of an IBAN by 97, digit by digit, so no large number is ever built."""
    bare = F.replace(code, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(
        c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).when(c == "", acc).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def confirmed(kind: Kind, hit: Column) -> Column:
    if kind is IP:
        value = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(value(p)) <= 3) & (F.substring(value(p), 1, 3).cast("int") <= 255))
    if kind is CARD:
        return F.length(_digits(hit)).between(13, 19) & F.call_function("luhn_check", F.substring(_digits(hit), 1, 19))
    if kind is PHONE:
        return F.length(_digits(hit)).between(9, 15)
    if kind is IBAN:
        return mod97(hit) == 1
    return F.lit(True)


def whole_words(words: str) -> str:
    """A pattern that finds any of the words standing alone; text ends are blanks in what it is used on."""
    return rf"[^\p{{L}}](?:{words})[^\p{{L}}]"


def around(start: Column, hit: Column) -> Column:
    """What stands within REACH characters of a match, in lower case, a word cut off at the edge with a letter before it."""
    first = F.greatest(start - REACH - 1, F.lit(0))
    after = F.substring(F.col("text"), start + F.length(hit) + 1, F.lit(REACH + 1))
    return F.lower(F.concat(F.when(start <= REACH + 1, " ").otherwise(""), F.substring(F.col("text"), first + 1, start - first), F.lit("  "), after,
                            F.when(F.length(after) <= REACH, " ").otherwise("")))


def score(kind: Kind, low: Column) -> Column:
    """Prior, plus a step for a word that fits, less a step for one that speaks against it."""
    return (F.lit(kind.prior) + F.when(low.rlike(whole_words(kind.context)), STEP).otherwise(0.0)
            - F.when(low.rlike(whole_words(AGAINST)), STEP).otherwise(0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all confirmed spans by kind, then start, as (kind, start, end, score)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none, noints = F.array().cast("array<string>"), F.array().cast("array<int>")
    hits = {k.name: F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)) for k in KINDS}
    d = d.select("*", *[(F.when(F.contains("text", F.lit(k.needs)), hits[k.name]).otherwise(none) if k.needs else hits[k.name])
                        .alias(f"{k.name}_hits") for k in KINDS])
    # gap, match, gap, match, ...: their lengths, of rows with a match only
    d = d.select("*", *[F.when(F.size(f"{k.name}_hits") > 0, F.flatten(F.transform(
        F.arrays_zip(F.split("text", k.pattern, -1).alias("g"), F.col(f"{k.name}_hits").alias("h")),
        lambda z: F.array(F.length(z["g"]), F.coalesce(F.length(z["h"]), F.lit(0)))))).otherwise(noints)
        .alias(f"{k.name}_lengths") for k in KINDS])
    d = d.select("doc_id", "text", *[f"{k.name}_hits" for k in KINDS],
                 *[F.when(F.size(f"{k.name}_hits") > 0, running_sums(F.col(f"{k.name}_lengths"))).otherwise(noints)
                   .alias(f"{k.name}_at") for k in KINDS])
    every = [_spans(k) for k in KINDS]
    return d.select("doc_id", F.concat(*every).alias("spans"))


def _spans(k: Kind) -> Column:
    """Confirmed and scored spans of one kind, from the columns of ``scan``."""
    rows = F.filter(F.transform(f"{k.name}_hits", lambda h, i: F.struct(
        h.alias("h"), F.element_at(F.col(f"{k.name}_at"), i * 2 + 2).alias("s"))), lambda r: confirmed(k, r["h"]))
    return F.transform(rows, lambda r: F.struct(
        F.lit(k.name).alias("kind"), r["s"].cast("long").alias("start"), (r["s"] + F.length(r["h"])).cast("long").alias("end"),
        score(k, around(r["s"], r["h"])).alias("score")))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, a count per kind, hash of the base spans, all spans as text, spans that score as likely."""
    names = [k.name for k in KINDS if k.base]
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select(
        "doc_id", *[count(n) for n in names], F.sha2(text(F.filter("spans", lambda s: s.kind.isin(names))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"), count("iban"),
        F.size(F.filter("spans", lambda s: s.score >= LIKELY)).cast("long").alias("n_likely"))


# ------------------------------------------------------------------ the same in SQL

def _hits_sql(kind: Kind) -> str:
    """Confirmed spans of one kind as a list of structs; text positions from split and extraction as above."""
    digits = "regexp_replace(h, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN "
            f"CASE WHEN 2 * {digits}[i]::INT > 9 THEN 2 * {digits}[i]::INT - 9 ELSE 2 * {digits}[i]::INT END ELSE {digits}[i]::INT END)) % 10 = 0")
    moved = "(replace(h, ' ', '')[5:] || replace(h, ' ', '')[1:4])"
    check = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(h, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND ('0' || ltrim(p, '0')[1:3])::INT <= 255))",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"(array_to_string(list_transform(string_split({moved}, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR "
                f"ELSE c END), ''))::HUGEINT % 97 = 1",
    }[kind.name]
    low = (f"lower(CASE WHEN s <= {REACH + 1} THEN ' ' ELSE '' END || substr(t, greatest(s - {REACH + 1}, 0) + 1, least(s, {REACH + 1})) || '  ' || "
           f"substr(t, s + length(h) + 1, {REACH + 1}) || CASE WHEN length(t) - s - length(h) <= {REACH} THEN ' ' ELSE '' END)")
    points = (f"{kind.prior}::DOUBLE + CASE WHEN regexp_matches({low}, '{whole_words(kind.context)}') THEN {STEP}::DOUBLE ELSE 0.0::DOUBLE END "
              f"- CASE WHEN regexp_matches({low}, '{whole_words(AGAINST)}') THEN {STEP}::DOUBLE ELSE 0.0::DOUBLE END")
    return (f"SELECT n, '{kind.name}' AS kind, {KINDS.index(kind)} AS k, s, s + length(h) AS e, {points} AS score FROM "
            f"(SELECT n, t, hs[i] AS h, (list_sum(list_transform(gs[1:i], lambda g: length(g))) "
            f"+ coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM "
            f"(SELECT n, t, hs, gs, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT n, t, regexp_extract_all(t, '{kind.plain}') AS hs, "
            f"string_split_regex(t, '{kind.plain}') AS gs FROM d) x1) x2) x3 WHERE {check}")


def oracle() -> str:
    base = [k for k in KINDS if k.base]
    joined = lambda where: (f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (WHERE {where}), '')")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in KINDS)
    return (f"WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents), "
            f"found AS ({' UNION ALL '.join(_hits_sql(k) for k in KINDS)}) "
            f"SELECT any_value(doc_id) AS doc_id, {counts}, sha256({joined(f'k < {len(base)}')}) AS base_sha256, "
            f"{joined('kind IS NOT NULL')} AS spans, count(*) FILTER (WHERE score >= {LIKELY}) AS n_likely "
            f"FROM d LEFT JOIN found USING (n) GROUP BY n")
