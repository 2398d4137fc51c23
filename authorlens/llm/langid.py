"""Language by cross-parsing: the language whose sample needs the fewest phrases wins.

For each language a suffix automaton of a bounded sample of its labelled text is built.  A text
is then parsed greedily against each automaton: a phrase is the longest match from where the
last one ended.  Its cost is the number of phrases times the bits that name a place in that
sample (log2 of its length), by character.  Low costs mean a familiar language.

Texts are cut into pieces of ``PIECE`` characters that are parsed side by side as array
operations, so a very long text is work for one task but never a long sequential loop; every
piece of the whole text counts.  A cut adds at most one phrase, alike for all languages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from authorlens.llm.tables import held_out

#: Bounds of what the model is fitted on: characters of a language's sample, and of one document in it.
SAMPLE_CHARS = 16_000
DOC_CHARS = 400
#: Rows of one language looked at for the sample, in the order of a hash of the text.
SAMPLE_ROWS = 400
ALPHABET = 128  # distinct characters told apart; rarer ones match nothing
PIECE = 128
UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    symbols: np.ndarray  # code point: symbol, 0 for none
    moves: np.ndarray  # (state, symbol): state, 0 for none; states of all languages in one table
    roots: np.ndarray
    bits: np.ndarray  # cost of a phrase


def folded(text: str | None) -> str:
    """Lower case, with every run of anything but letters as one space."""
    return NO_LETTERS.sub(" ", (text or "").lower())


def automaton(text: str) -> list[dict[str, int]]:
    """Suffix automaton of a text: transitions of each state, the root first."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at, last = last, new
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at < 0:
            continue
        to = moves[at][c]
        if length[to] == length[at] + 1:
            link[new] = to
            continue
        copy = len(moves)
        moves.append(dict(moves[to]))
        link.append(link[to])
        length.append(length[at] + 1)
        while at >= 0 and moves[at].get(c) == to:
            moves[at][c] = copy
            at = link[at]
        link[to] = link[new] = copy
    return moves


def fit(samples: dict[str, str]) -> Model:
    """A model of one sample text per language, in the order of their names."""
    langs = tuple(sorted(samples))
    counts: dict[str, int] = {}
    for lang in langs:
        for c in set(samples[lang]):
            counts[c] = counts.get(c, 0) + samples[lang].count(c)
    kept = sorted(counts, key=lambda c: (-counts[c], c))[:ALPHABET - 1]
    symbols = np.zeros(0x110000, np.uint8)
    for i, c in enumerate(sorted(kept)):
        symbols[ord(c)] = i + 1
    tables, roots, base = [np.zeros((1, ALPHABET), np.int32)], [], 1
    for lang in langs:
        states = automaton(samples[lang])
        part = np.zeros((len(states), ALPHABET), np.int32)
        for i, out in enumerate(states):
            for c, to in out.items():
                if symbols[ord(c)]:
                    part[i, symbols[ord(c)]] = base + to
        tables.append(part)
        roots.append(base)
        base += len(states)
    bits = np.array([np.log2(max(2, len(samples[lang]))) for lang in langs])
    return Model(langs, symbols, np.concatenate(tables), np.array(roots, np.int32), bits)


def phrases(model: Model, texts: list[str]) -> np.ndarray:
    """(text, language): phrases of the greedy parse of each text's pieces."""
    langs = len(model.langs)
    out = np.zeros((len(texts), langs))
    for lo in range(0, len(texts), 512):
        _add_phrases(model, texts[lo:lo + 512], out[lo:lo + 512])
    return out


def _add_phrases(model: Model, texts: list[str], out: np.ndarray) -> None:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    n_pieces = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(texts)), n_pieces)
    first = np.repeat(np.cumsum(sizes) - sizes, n_pieces)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    starts = first + rank * PIECE
    lengths = np.minimum(PIECE, np.repeat(sizes, n_pieces) - rank * PIECE)
    order = np.argsort(-lengths, kind="stable")
    langs = len(model.langs)
    flat = model.moves.reshape(-1)
    for at in range(0, len(order), 4096):
        lanes = order[at:at + 4096]  # longest first: the lanes still running are a prefix
        longest = int(lengths[lanes[0]])
        where = np.minimum(starts[lanes] + np.arange(longest)[:, None], len(codes) - 1)
        symbols = model.symbols[codes[where]].astype(np.int32)
        running = np.searchsorted(-lengths[lanes], -np.arange(longest), side="left")
        state = np.repeat(model.roots[:, None], len(lanes), axis=1)
        roots = state.copy()
        count = np.zeros((langs, len(lanes)), np.int32)
        for i in range(longest):
            k = running[i]
            s = symbols[i, :k]
            to = flat[state[:, :k] * ALPHABET + s]
            ended = np.nonzero(to == 0)
            if len(ended[0]):
                # a phrase ends before this character, which begins the next one
                count[ended] += state[ended] != roots[ended]
                again = flat[roots[ended] * ALPHABET + s[ended[1]]]
                lost = again == 0  # a character the sample lacks is a phrase of its own
                count[ended[0][lost], ended[1][lost]] += 1
                to[ended] = np.where(lost, roots[ended], again)
            state[:, :k] = to
        count += state != roots
        np.add.at(out, owner[lanes], count.T)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 without any letter, or if nothing was learned."""
    low = [folded(t) for t in texts]
    lettered = np.fromiter((any(map(str.isalpha, t)) for t in low), bool, len(low))
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    sizes = np.maximum(1, np.fromiter(map(len, low), np.int64, len(low)))
    cost = phrases(model, low) * model.bits
    best = cost.argmin(1)
    # how much likelier the best parse is than all together, by the bits it saves; long texts count as 64 characters
    saved = (cost - cost.min(1, keepdims=True)) / sizes[:, None] * np.minimum(sizes, 64)[:, None]
    score = 1 / np.exp2(-np.minimum(saved, 1000)).sum(1)
    return ([model.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0))


def learn(docs: DataFrame) -> Model:
    """Fit on rows that are not held out and have a language: at most SAMPLE_ROWS rows a language, of all its rows
    those of smallest hash, and at most DOC_CHARS characters of each and SAMPLE_CHARS in all."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", F.struct(F.xxhash64("text").alias("h"), F.substring("text", 1, DOC_CHARS).alias("t")).alias("r"))
    # the smallest hashes of each language, kept small in every partial aggregate by a salt
    salted = rows.groupBy("lang", F.pmod(F.col("r.h"), F.lit(SAMPLE_ROWS)).alias("salt")).agg(F.min("r").alias("r"))
    picked = salted.groupBy("lang").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    samples = {}
    for row in picked.collect():  # bounded: languages x SAMPLE_ROWS x DOC_CHARS
        text = "\n".join(folded(r["t"]) for r in row["rs"])[:SAMPLE_CHARS]
        if text:
            samples[row["lang"]] = text
    return fit(samples)


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), row by row; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, score = predict(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents; the model is learned from the rest of them.

    Null ids are not held out; a language of null is no class; an empty table, or one without labels, gives ``und``.
    """
    found = detect(docs, learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
