"""Counts and ids against the library; packs against the histogram; a round trip of pieces."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from authorlens.llm import packing, tokens
from tests.llm.odd import LONG, ROWS, docs, none

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(6)
BITS = [*"aA bB  \n\t.,'sS've0123ñÉüİ\x1c\x85  <|>ßJ̌中文🙂_- 　\r", "<|endoftext|>", "<|startoftext|>", "'ll", " the", "  "]
TEXTS = ["".join(rng.choices(BITS, k=rng.randrange(0, 40))) for _ in range(3_000)] + ["", LONG, " " * 5_000, "x" * 3_000, "\n " * 900 + "a"]


def test_counts():
    tok, count = Tokenizer.from_file(WORDS), tokens.Counter(tokens.vocabulary(WORDS), tokens.whole_tokens(tokens.vocabulary(WORDS))).count
    assert [t for t in TEXTS if count(t) != len(tok.encode(t, add_special_tokens=False).ids)] == []
    assert count(None) == 0


def test_memo_forgets():
    memo = tokens.Memo(len, 10)
    assert [memo[str(i)] for i in range(100)] == [len(str(i)) for i in range(100)] and len(memo) + len(memo.old) <= 20


def test_ids():
    tok, ids = Tokenizer.from_file(BYTES), packing.Encoder(tokens.vocabulary(BYTES)).ids
    for t in TEXTS:
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids(t) == struct.pack(f"<{len(want)}I", *want)
    assert packing.Encoder(tokens.vocabulary(BYTES)).ids(None) == b""


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_every_piece_once(seed):
    r = random.Random(seed)
    histogram = {r.randrange(1, 2049): r.choice((1, 2, 5, 400)) for _ in range(r.choice((1, 5, 300)))}
    packs = packing.patterns(histogram, 2048)
    held = Counter()
    for pattern, n in packs:
        assert n > 0 and sum(pattern) <= 2048
        held.update({length: k * n for length, k in Counter(pattern).items()})
    assert held == histogram


def test_odd_rows(spark):
    tok = Tokenizer.from_file(BYTES)
    got = packing.packed(docs(spark), BYTES).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text, *_ in ROWS:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        times = sum((d, t or "") == (doc_id, text or "") for d, t, *_ in ROWS)
        parts = sorted(by[doc_id, len(ids)], key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(ids) * times
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start:r.start + r.length])) for r in parts)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.packed(none(spark), BYTES).count() == 0
    counts = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.counts(docs(spark), WORDS).collect()}
    assert {(1, 0, 0, False), (2, 0, 0, False), (4, len(LONG), len(Tokenizer.from_file(WORDS).encode(LONG, add_special_tokens=False).ids), True)} <= counts
    assert tokens.counts(none(spark), WORDS).count() == 0
