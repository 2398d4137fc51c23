"""Token counts: vocabulary strings proven to be one token are counted by look-up, only the rest is merged.

A text is cut where the tokenizer's own pre-tokens can never cross (blanks), so a chunk's
count does not depend on its neighbours and is remembered.  A chunk that is new is cut into
pre-tokens; if every one is a proven whole token, they are counted, else the library merges
the chunk.  Texts in which that cut could be wrong go to the library whole: those holding a
special string, which the library finds before anything else, or an ASCII separator
(0x1C-0x1F), a blank to Python but not to the tokenizer.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

REMEMBERED = 250_000  # strings a memo keeps, and as many older ones
LONG = 64  # longer chunks are not remembered
SEPARATORS = regex.compile("[\x1c-\x1f]")


def vocabulary(path: str) -> str:
    """The tokenizer's definition as text; it is read once and sent to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(definition: str) -> frozenset[str]:
    """Strings of the vocabulary that the library itself encodes, alone, as that one token.

    A string counts only if normalising leaves it alone and the pre-tokenizer keeps it in one
    piece, so the same string met as a pre-token is merged to the same single token.
    """
    tok, model = Tokenizer.from_str(definition), json.loads(definition)["model"]
    end, of = model.get("end_of_word_suffix") or "", byte_characters()
    texts = {}
    for word, i in model["vocab"].items():
        bare = word[:len(word) - len(end)]
        if bare and word.endswith(end) and all(c in of for c in bare):
            try:
                texts[bytes(of[c] for c in bare).decode()] = i
            except UnicodeDecodeError:
                pass  # part of a character: never a text of its own
    names = list(texts)
    found = tok.encode_batch(names, add_special_tokens=False)
    return frozenset(t for t, e in zip(names, found) if e.ids == [texts[t]] and (
        tok.normalizer is None or tok.normalizer.normalize_str(t) == t) and len(tok.pre_tokenizer.pre_tokenize_str(t)) == 1)


class Memo(dict):
    """Results by string, at most twice ``size`` of them: what was not asked for while ``size`` others came is forgotten."""

    def __init__(self, work, size: int = REMEMBERED):
        super().__init__()
        self.work, self.size, self.old = work, size, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= LONG:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Counter:
    """Counts tokens of texts; a worker keeps one, with what it has seen."""

    def __init__(self, definition: str, whole: frozenset[str]):
        self.tok, self.whole = Tokenizer.from_str(definition), whole
        stages = json.loads(definition)
        self.special = [t["content"] for t in stages["added_tokens"]]
        self.pieces = regex.compile(stages["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.chunks, self.rest = Memo(self.chunk), Memo(self.merged)

    def merged(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def chunk(self, chunk: str) -> int:
        plain = chunk.isascii()  # then lower case is all there is to normalise
        parts = self.pieces.findall(chunk.lower() if plain else self.tok.normalizer.normalize_str(chunk))
        more = [p for p in parts if p not in self.whole]
        if more and not plain:
            return self.merged(chunk)
        return len(parts) - len(more) + sum(map(self.rest.__getitem__, more))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special) or SEPARATORS.search(text):
            return self.merged(text)
        return sum(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=1)
def counter(definition: str, whole: frozenset[str]) -> Counter:
    return Counter(definition, whole)


def counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text; null is empty; rows stay rows, nothing is shuffled."""
    definition = vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((definition, whole_tokens(definition)))  # bounded by the vocabulary

    def run(batches):
        count = counter(*shared.value).count
        for b in batches:
            n = np.fromiter(map(count, b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
