"""Fingerprints against a bit-by-bit version, links against all pairs, components against a union-find."""

import random

import pytest
import xxhash

from authorlens.llm import simhash
from authorlens.operators.graph import components


def slow_print(text, width=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots_of(nodes, near):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {n: top(n) for n in nodes}


TEXTS = ["", None, "one", "One  TWO", "one two three", "ONE\ttwo\nthree", "Äpfel İx one two", "a b c d a b c d a b c d",
         "word " * 70_000, "\x1c one two three four", "one\x85two three four five"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.majority_bits(simhash.shingle_hashes(text, 3)) == slow_print(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot", [64, 1])
def test_groups_match_all_pairs(spark, hot):
    rng = random.Random(5)
    prints = [0, (1 << 64) - 1]
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(15):
            prints.append(at)
            for _ in range(rng.choice((1, 1, 2, 3))):
                at ^= 1 << rng.randrange(64)
    rng.shuffle(prints)
    rows = [(i, signed(p)) for i, p in enumerate(prints)] + [(500, signed(prints[3]))]
    want = roots_of([i for i, _ in rows], lambda a, b: bin((dict(rows)[a] ^ dict(rows)[b]) & (1 << 64) - 1).count("1") <= 2)
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long"), hot).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)


def test_every_pair_within_two_bits_shares_a_codeword():
    import numpy as np
    rng = random.Random(1)
    values = [rng.getrandbits(23) for _ in range(200)]
    other = [v ^ (1 << rng.randrange(23)) ^ (1 << rng.randrange(23)) for v in values]
    a, b = simhash.codewords(np.array(values), 23), simhash.codewords(np.array(other), 23)
    assert all({*x} & {*y} - {-1} for x, y in zip(a.tolist(), b.tolist()))
    assert max((x >= 0).sum() for x in a) <= 6


def test_documents_with_odd_rows(spark):
    rows = [(1, "", "x"), (2, None, "x"), (None, "one two three four", None), (7, "one two three four", "y"), (7, "one two three four", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    f = format(slow_print("one two three four"), "016x")
    assert got == [(-1, f, 7), (1, "0" * 16, 1), (2, "0" * 16, 1), (7, f, 7), (7, f, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(5, 5)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    linked = {tuple(sorted(e)) for e in edges}
    want = roots_of(nodes, lambda a, b: tuple(sorted((a, b))) in linked)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(nodes)
