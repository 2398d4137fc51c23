"""Planted passages, whole, in part and edited, and a brute-force edit distance over all windows."""

import random

from authorlens.llm import decontam
from tests.llm.odd import docs, none

rng = random.Random(4)
WORDS = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(3_000)]


def prose(n):
    return " ".join(rng.choices(WORDS, k=n))


def edited(text, n):
    chars = list(text)
    for at in rng.sample(range(len(chars)), n):
        chars[at] = rng.choice(["", "z", chars[at] + "q"])
    return "".join(chars)


def least_edits(window, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(items, text):
    low, found = decontam.folded(text), set()
    for i, item in items:
        item = decontam.folded(item)
        w = min(decontam.WINDOW, len(item))
        if len(item) < decontam.Q:  # too short for a q-gram: whole words
            if item and f" {item} " in f" {low} ":
                found.add(i)
        elif any(least_edits(item[s:s + w], low) <= decontam.edits(w) for s in range(len(item) - w + 1)):
            found.add(i)
    return found


ITEMS = [(0, prose(40)), (1, prose(30)), (2, prose(12)), (3, "Short one, here"), (4, "tiny"), (5, ""), (6, None)]


def test_against_all_windows():
    texts = [prose(60)]
    for i, item in ITEMS[:4]:
        texts += [prose(20) + " " + item + " " + prose(20), prose(9) + " " + edited(item, min(3, len(item) // 30)) + " " + prose(9)]
    texts += [prose(9) + " " + ITEMS[0][1][50:115].upper() + " " + prose(9), prose(9) + ITEMS[1][1][20:70] + prose(9), "so tiny a thing", "tinyish", ITEMS[2][1]]
    ix = decontam.index(ITEMS)
    got = {}
    for d, item, start, end, cost in decontam.batched_leaks(ix, texts):
        got.setdefault(d, set()).add(item)
        assert 0 <= start < end
    assert [got.get(i, set()) for i in range(len(texts))] == [brute(ITEMS, t) for t in texts]
    assert sum(map(len, got.values())) >= 8


def test_edited_passages_are_found():
    ix = decontam.index([(7, t := prose(60))])
    for _ in range(40):
        at = rng.randrange(0, len(t) - 61)
        text = prose(30) + " " + edited(t[at:at + 64], 2) + " " + prose(30)
        assert ({7} if brute([(7, t)], text) else set()) == {item for _, item, *_ in decontam.leaks(ix, [text])}


def test_frames(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(10, prose(8) + " " + ITEMS[1][1], *["x"] * 2, 1, "x", 1), (None, ITEMS[0][1], *["x"] * 2, 1, "x", 1)]
    some = docs(spark).unionByName(docs(spark, rows))
    for size in (decontam.BLOCK_CHARS, 100):  # in one block and in several
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        assert {(r.doc_id, r.item_id) for r in decontam.found_leaks(some, bench).collect()} == {(10, 1), (None, 0)}
        assert sorted(map(str, decontam.clean(some, bench).collect())) == sorted(map(str, docs(spark).collect()))
    assert decontam.found_leaks(none(spark), bench).count() == 0
    assert decontam.clean(some, bench.limit(0)).count() == some.count()
