"""Queries over pairs of texts and over tag trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from authorlens.catalog import inputs as I
from authorlens.functions.text import nonblank_lines
from authorlens.operators import scoring, similarity as sim, tree

WS, WORD = I.WS, I.WORD


def _r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# ------------------------------------------------------------------ similarity

def copy_groups(spark, sf):
    return sim.copy_groups(I.documents(spark, sf))


def kgram_similarity_pairs(spark, sf):
    return _r6(sim.similar_texts(I.documents(spark, sf, busy=True), t=0.4), "similarity")


def suspicious_pairs(spark, sf):
    return _r6(sim.suspicious_pairs(I.documents(spark, sf, busy=True)), "similarity")


def shingle_jaccard_pairs(spark, sf):
    return _r6(sim.similar_texts(I.documents(spark, sf, busy=True), t=0.5, measure="jaccard"), "similarity")


def similarity_tiers(spark, sf):
    p = sim.similar_texts(I.documents(spark, sf, busy=True), t=0.4)
    return p.groupBy(scoring.similarity_tier(F.col("similarity")).alias("tier"),
                     F.when(scoring.percent(F.col("similarity")) >= 85, F.lit("red")).otherwise(F.lit("amber")).alias("colour")).agg(
        F.count(F.lit(1)).alias("n"))


def pairs_at_least(spark, sf):
    return _r6(sim.at_least(sim.similar_texts(I.documents(spark, sf, busy=True), t=0.4), 0.9), "similarity").select("id_a", "id_b", "similarity")


def blocked_pairs(spark, sf):
    return _r6(sim.blocked_pairs(I.documents(spark, sf, busy=True), "lang", t=0.6), "similarity")


def similarity_cells(spark, sf):
    d = I.documents(spark, sf, busy=True)
    pairs = sim.similar_texts(d, t=0.4)
    ids = sim.copy_groups(d).select(F.col("rep").alias("id"))
    return sim.matrix_cells(pairs, ids)


def pair_sources(spark, sf):
    d = I.documents(spark, sf, busy=True)
    lens = d.select("id", F.length("code").cast("bigint").alias("len"))  # taken before the join, which then carries no text
    return sim.pair_sources(sim.similar_texts(d, t=0.7).select("id_a", "id_b"), lens, ("len",)).select("id_a", "id_b", "len_a", "len_b")


def pair_bounds(spark, sf):
    d = I.documents(spark, sf, busy=True)
    pairs = sim.similar_texts(d, t=0.4).filter("id_a <> id_b")
    return _r6(sim.pair_bounds(pairs, d), "length_bound", "char_bound")


def similarity_classes(spark, sf):
    return sim.similarity_classes(I.documents(spark, sf, busy=True), t=0.4)


def lsh_classes(spark, sf):
    return sim.lsh_classes(I.documents(spark, sf, busy=True))


def lsh_recall(spark, sf):
    return _r6(sim.lsh_recall(I.documents(spark, sf, busy=True)), "recall")


def char_bound_classes(spark, sf):
    return sim.char_bound_classes(I.documents(spark, sf))


def length_partners(spark, sf):
    return sim.length_partners(I.documents(spark, sf)).select("id", "len", "partners")


_STRIPPED = f"(SELECT id, lang, {I.strip_sql('code')} AS code FROM ({I.DOCUMENTS}) d0)"
_GROUPS = f"(SELECT min(id) AS id, count(*) AS copies, code FROM {_STRIPPED} s GROUP BY code)"


def _grams_sql(source: str, block: str = "''") -> str:
    return (f"(SELECT id, g, count(*) AS c FROM (SELECT id, {block} || array_to_string(toks[i:i + 2], ' ') AS g FROM (SELECT *, "
            f"unnest(range(1, greatest(len(toks) - 1, least(len(toks), 1) + 1))) AS i FROM (SELECT *, regexp_extract_all(code, '{I.TOKEN}') AS toks FROM {source} g0) g1) g2) g3 GROUP BY id, g)")


def _pairs_sql(source: str, block: str = "''", measure: str = "dice") -> str:
    """All pairs that share a k-gram, scored by brute force."""
    value = "c" if measure == "dice" else "1"
    score = ("2.0::DOUBLE * o / (na.n + nb.n)" if measure == "dice" else "o / (na.n + nb.n - o)::DOUBLE")
    return (f"(WITH grams AS {_grams_sql(source, block)}, sizes AS (SELECT id, sum({value}) AS n FROM grams GROUP BY id) SELECT id_a, id_b, {score} AS similarity FROM "
            f"(SELECT a.id AS id_a, b.id AS id_b, sum(least(a.{'c' if measure == 'dice' else 'one'}, b.{'c' if measure == 'dice' else 'one'})) AS o FROM "
            f"(SELECT *, 1 AS one FROM grams) a JOIN (SELECT *, 1 AS one FROM grams) b ON a.g = b.g AND a.id < b.id GROUP BY ALL) m "
            f"JOIN sizes na ON na.id = id_a JOIN sizes nb ON nb.id = id_b)")


def _similar_sql(t: str, measure: str = "dice", op: str = ">=") -> str:
    return (f"(SELECT id_a, id_b, similarity, ga.copies AS copies_a, gb.copies AS copies_b FROM {_pairs_sql(_GROUPS, measure=measure)} p JOIN {_GROUPS} ga ON ga.id = id_a "
            f"JOIN {_GROUPS} gb ON gb.id = id_b WHERE similarity {op} {t}::DOUBLE UNION ALL SELECT id, id, 1.0, copies, copies FROM {_GROUPS} g WHERE copies > 1)")


def _classes_sql(pairs: str) -> str:
    """Class and links of every document from pairs of representatives, by walking the links."""
    return (f"WITH RECURSIVE p AS MATERIALIZED (SELECT id_a, id_b FROM {pairs} q WHERE id_a <> id_b), ends AS MATERIALIZED (SELECT id_a AS a, id_b AS b FROM p "
            f"UNION ALL SELECT id_b, id_a FROM p), g AS MATERIALIZED {_GROUPS}, walk AS (SELECT id AS node, id AS root FROM g UNION SELECT ends.b, walk.root FROM walk JOIN ends "
            f"ON ends.a = walk.node), roots AS (SELECT node, min(root) AS class_id FROM walk GROUP BY node), links AS (SELECT a, sum(copies) AS n FROM ends JOIN g ON g.id = b "
            f"GROUP BY a), named AS (SELECT g.code, class_id, (coalesce(n, 0) + copies - 1)::BIGINT AS n_links FROM g JOIN roots ON node = g.id LEFT JOIN links ON a = g.id) "
            f"SELECT s.id, class_id, n_links FROM {_STRIPPED} s JOIN named USING (code)")


# ------------------------------------------------------------------ trees

def _events(spark, sf):
    return tree.events_from_html(I.pages(spark, sf), "code")


def tree_events(spark, sf):
    return tree.with_depth(_events(spark, sf))


def tree_depth(spark, sf):
    return tree.tree_depth(_events(spark, sf))


def node_types(spark, sf):
    return _r6(tree.node_types(_events(spark, sf)), "unique_node_type_ratio")


def role_counts(spark, sf):
    return tree.role_counts(_events(spark, sf))


def densities(spark, sf):
    lines = I.pages(spark, sf).select("id", nonblank_lines(F.col("code")).alias("filled"))
    d = tree.densities(_events(spark, sf), lines)
    return _r6(d, *[c for c in d.columns if c != "id"])


def nesting(spark, sf):
    return _r6(tree.nesting(_events(spark, sf)), "avg_nesting_depth", "cyclomatic_complexity_approx")


def block_spans(spark, sf):
    return tree.spans(_events(spark, sf)).select("id", "seq", "type", "start", "finish")


def role_lengths(spark, sf):
    return _r6(tree.role_lengths(_events(spark, sf)), "avg_function_length")


_BALANCED = "'head', 'title', 'style', 'script', 'nav', 'ul', 'li', 'a', 'div', 'article', 'h1', 'footer'"
_ROLE = ("CASE type WHEN 'div' THEN 'function' WHEN 'article' THEN 'class' WHEN 'ul' THEN 'for' WHEN 'li' THEN 'if' WHEN 'nav' THEN 'while' "
         "WHEN 'script' THEN 'try' WHEN 'meta' THEN 'import' WHEN 'b' THEN 'lambda' END")
_BARE = ("regexp_replace(regexp_replace(code, '(?is)(<script[^>]*>).*?(</script)', '\\1\\2', 'g'), '(?is)(<style[^>]*>).*?(</style)', '\\1\\2', 'g')")
_EVENTS = (
    f"(SELECT *, sum(delta) OVER w AS depth, sum(CASE WHEN role IN ('if', 'for', 'while', 'function') THEN delta ELSE 0 END) OVER w AS nest FROM "
    f"(SELECT id, pos * 2 + k AS seq, d AS delta, type, {_ROLE} AS role, line FROM (SELECT *, unnest(ds) AS d, generate_subscripts(ds, 1) - 1 AS k FROM "
    f"(SELECT id, pos, type, line, CASE WHEN type IN ({_BALANCED}) THEN CASE WHEN shut THEN [-1] ELSE [1] END WHEN shut THEN []::INT[] ELSE [1, -1] END AS ds FROM "
    f"(SELECT id, pos, lower(regexp_replace(m, '[</]+', '')) AS type, starts_with(m, '</') AS shut, m = chr(10) AS brk, "
    f"1 + sum((m = chr(10))::INT) OVER (PARTITION BY id ORDER BY pos) AS line FROM (SELECT id, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS pos FROM "
    f"(SELECT id, regexp_extract_all({_BARE}, '\\n|</?[a-zA-Z][a-zA-Z0-9]*') AS ms FROM ({I.PAGES}) t0) t1) t2) t3 WHERE NOT brk) t4) t5) t6 "
    f"WINDOW w AS (PARTITION BY id ORDER BY seq))")
_ROLES = ["function", "class", "if", "for", "while", "try", "import", "lambda"]
_ROLE_N = ", ".join(f"count(*) FILTER (WHERE delta = 1 AND role = '{r}') AS n_{r}" for r in _ROLES)

QUERIES = {f.__name__: f for f in (
    copy_groups, kgram_similarity_pairs, suspicious_pairs, shingle_jaccard_pairs, similarity_tiers, pairs_at_least, blocked_pairs,
    similarity_cells, pair_sources, pair_bounds, similarity_classes, lsh_classes, lsh_recall, char_bound_classes, length_partners, tree_events, tree_depth, node_types, role_counts,
    densities, nesting, block_spans, role_lengths)}

_CHARS = ("(SELECT id, x, count(*) AS c FROM (SELECT id, unnest(string_split(code, '')) AS x FROM " + _STRIPPED + " c0) c1 GROUP BY id, x)")
_PCT = "floor(similarity * 100 + 0.5)"

ORACLE = {
    "copy_groups": f"SELECT id AS rep, copies FROM {_GROUPS} g",
    "kgram_similarity_pairs": f"SELECT id_a, id_b, round(similarity, 6) AS similarity, copies_a, copies_b FROM {_similar_sql('0.4')} p",
    "suspicious_pairs": f"SELECT id_a, id_b, round(similarity, 6) AS similarity, copies_a, copies_b FROM {_similar_sql('0.7', op='>')} p",
    "shingle_jaccard_pairs": f"SELECT id_a, id_b, round(similarity, 6) AS similarity, copies_a, copies_b FROM {_similar_sql('0.5', 'jaccard')} p",
    "similarity_classes": _classes_sql(_similar_sql("0.4")),
    "lsh_classes": _classes_sql(_similar_sql("0.8", "jaccard")),
    "char_bound_classes": _classes_sql(f"(SELECT id_a, id_b FROM (SELECT a.id AS id_a, b.id AS id_b, sum(least(a.c, b.c)) AS o FROM ch a JOIN ch b ON a.x = b.x AND a.id < b.id "
                                       f"GROUP BY ALL) o JOIN l a ON a.id = id_a JOIN l b ON b.id = id_b WHERE 2.0::DOUBLE * o / (a.n + b.n) >= 0.7::DOUBLE)")
    .replace("WITH RECURSIVE ", f"WITH RECURSIVE ch AS MATERIALIZED (SELECT id, x, count(*) AS c FROM (SELECT id, unnest(string_split(code, '')) AS x FROM {_GROUPS} g0) c1 GROUP BY id, x), "
                                f"l AS (SELECT id, length(code) AS n FROM {_GROUPS} g1), "),
    "similarity_tiers": f"SELECT CASE WHEN {_PCT} >= 80 THEN 'Very high similarity' WHEN {_PCT} >= 60 THEN 'High similarity' WHEN {_PCT} >= 40 THEN 'Moderate' "
                        f"ELSE 'Low similarity' END AS tier, CASE WHEN {_PCT} >= 85 THEN 'red' ELSE 'amber' END AS colour, count(*) AS n FROM {_similar_sql('0.4')} p GROUP BY ALL",
    "pairs_at_least": f"SELECT id_a, id_b, round(similarity, 6) AS similarity FROM {_similar_sql('0.4')} p WHERE round(similarity, 4) >= 0.9::DOUBLE",
    "blocked_pairs": f"WITH g AS (SELECT min(id) AS id, count(*) AS copies, lang, code FROM {_STRIPPED} s GROUP BY lang, code) SELECT id_a, id_b, round(similarity, 6) AS "
                     f"similarity, a.copies AS copies_a, b.copies AS copies_b FROM {_pairs_sql('g', 'lang || chr(10)')} p JOIN g a ON a.id = id_a JOIN g b ON b.id = id_b "
                     f"WHERE similarity >= 0.6::DOUBLE UNION ALL SELECT id, id, 1.0, copies, copies FROM g WHERE copies > 1",
    "similarity_cells": f"WITH p AS (SELECT id_a, id_b, round(similarity, 4) AS similarity FROM {_similar_sql('0.4')} q WHERE id_a <> id_b) SELECT * FROM p UNION ALL "
                        f"SELECT id_b, id_a, similarity FROM p UNION ALL SELECT id, id, 1.0 FROM {_GROUPS} g",
    "pair_sources": f"SELECT id_a, id_b, length(a.text) AS len_a, length(b.text) AS len_b FROM {_similar_sql('0.7')} p JOIN documents a ON a.doc_id = id_a JOIN documents b ON b.doc_id = id_b",
    "pair_bounds": f"WITH p AS (SELECT id_a, id_b FROM {_similar_sql('0.4')} q WHERE id_a <> id_b), ch AS {_CHARS}, l AS (SELECT id, length(code) AS n FROM {_STRIPPED} s), "
                   f"o AS (SELECT id_a, id_b, sum(least(a.c, b.c)) AS o FROM p JOIN ch a ON a.id = id_a JOIN ch b ON b.id = id_b AND a.x = b.x GROUP BY id_a, id_b) "
                   f"SELECT id_a, id_b, round(2.0::DOUBLE * least(a.n, b.n) / (a.n + b.n), 6) AS length_bound, round(2.0::DOUBLE * o / (a.n + b.n), 6) AS char_bound "
                   f"FROM o JOIN l a ON a.id = id_a JOIN l b ON b.id = id_b",
    "length_partners": f"WITH l AS (SELECT id, length(code) AS n FROM {_STRIPPED} s), h AS (SELECT n, count(*) AS c FROM l GROUP BY n) SELECT id, l.n AS len, (k - 1)::BIGINT AS partners "
                       f"FROM l JOIN (SELECT a.n, sum(b.c) AS k FROM h a JOIN h b ON 2.0::DOUBLE * least(a.n, b.n) >= 0.7::DOUBLE * (a.n + b.n) - 1e-9 GROUP BY a.n) m USING (n)",
    "tree_events": f"SELECT id, seq, delta::BIGINT AS delta, type, role, line::BIGINT AS line, depth::BIGINT AS depth, nest::BIGINT AS nest FROM {_EVENTS} e",
    "tree_depth": f"SELECT id, max(depth)::BIGINT AS ast_depth FROM {_EVENTS} e GROUP BY id",
    "node_types": f"SELECT id, count(*) AS ast_node_count, round(count(DISTINCT type) / count(*)::DOUBLE, 6) AS unique_node_type_ratio FROM {_EVENTS} e WHERE delta = 1 GROUP BY id",
    "role_counts": f"SELECT id, {_ROLE_N} FROM {_EVENTS} e GROUP BY id",
    "densities": f"SELECT id, " + ", ".join(f"round(n_{r} / filled::DOUBLE, 6) AS {r}_density" for r in _ROLES)
                 + f", round(nodes / filled::DOUBLE, 6) AS ast_nodes_per_line FROM (SELECT id, {_ROLE_N}, count(*) FILTER (WHERE delta = 1) AS nodes FROM {_EVENTS} e GROUP BY id) c JOIN "
                   f"(SELECT id, greatest(count(*) FILTER (WHERE regexp_matches(line, '[^{WS}]')), 1) AS filled FROM {I.lines_sql(I.PAGES)} l GROUP BY id) k USING (id)",
    "nesting": f"SELECT id, coalesce(max(nest) FILTER (WHERE i), 0)::BIGINT AS max_nesting_depth, round(coalesce(avg(nest) FILTER (WHERE i), 0), 6) AS avg_nesting_depth, "
               f"round((1 + count(*) FILTER (WHERE delta = 1 AND role IN ('if', 'for', 'while', 'try')))::DOUBLE / greatest(count(*) FILTER (WHERE delta = 1 AND role = 'function'), 1), 6) "
               f"AS cyclomatic_complexity_approx FROM (SELECT *, delta = 1 AND coalesce(role IN ('if', 'for', 'while', 'function'), false) AS i FROM {_EVENTS} e) f GROUP BY id",
    "block_spans": f"WITH e AS {_EVENTS} SELECT o.id, o.seq, o.type, o.line::BIGINT AS start, (SELECT c.line FROM e c WHERE c.id = o.id AND c.seq > o.seq AND c.depth < o.depth "
                   f"ORDER BY c.seq LIMIT 1)::BIGINT AS finish FROM e o WHERE o.delta = 1",
    "role_lengths": f"WITH e AS {_EVENTS}, s AS (SELECT o.id, (SELECT c.line FROM e c WHERE c.id = o.id AND c.seq > o.seq AND c.depth < o.depth ORDER BY c.seq LIMIT 1) - o.line + 1 AS n "
                    f"FROM e o WHERE o.delta = 1 AND o.role = 'function') SELECT id, round(avg(n), 6) AS avg_function_length, max(n)::BIGINT AS max_function_length FROM s GROUP BY id",
}
