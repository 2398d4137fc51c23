"""Toxicity: a factorization machine over hashed terms.

Terms are words and their beginnings; the latter catch stems that take many endings.  Every term
of at least ``LEAST_TEXTS`` labelled texts has a place in a table of hashes, with a weight and a
short vector; the products of the vectors of all pairs of terms in a text give what a pair means
beyond its parts (an insult next to a group).  All pairs cost no more than the terms: half the
square of the sum less the sum of squares.

The machine is fitted on a bounded sample of labelled rows, with AdaGrad.  First come the weights
of terms whose classes differ by more than chance (log-likelihood ratio).  Then the vectors of all
terms, common or rare, learn what these weights leave unexplained; a vector shrinks a little
whenever it is met, so those that no pair needs end at zero and leave the machine.  At last the
bias is set back to the shares of the classes among all labelled rows; scoring is row by row.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from authorlens.llm.tables import held_out
from authorlens.llm.tokens import Memo
from authorlens.session import cut_lineage

#: Bound of the fit: labelled rows of each class, drawn by a hash of the id.
SAMPLE_ROWS = 4_000
TABLE_BITS = 24  # places of the hash table; a term's place is the end of its CRC-32
LEAST_TEXTS = 3
#: From this likelihood ratio on a term gets a weight; vectors are for all terms.
LEAST_RATIO = 12.0
FACTORS = 4
EPOCHS, BATCH, RATE, DECAY = 20, 64, 0.2, 1e-4
FACTOR_EPOCHS, FREE_EPOCHS, FACTOR_RATE, FACTOR_SHRINK, FACTOR_START = 6, 2, 0.5, 0.03, 0.1
PREFIXES = (4, 5, 6, 7)
REMEMBERED = 80_000  # words
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Machine:
    bias: float
    places: dict[int, int]  # place of a term in the table: its row
    weights: np.ndarray
    factors: np.ndarray


def word_hashes(word: str) -> list[int]:
    """Places of a word and of its beginnings."""
    names = {"w" + word, *("p" + word[:n] for n in PREFIXES if len(word) >= n)}
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << TABLE_BITS) - 1) for n in names]


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Reader:
    """Rows of the machine's terms in a text; what a word means to it is remembered."""

    def __init__(self, places: dict[int, int]):
        self.places, self.memo = places, Memo(self.word, REMEMBERED)

    def word(self, word: str) -> bytes:
        return np.array([self.places[h] for h in word_hashes(word) if h in self.places], "<u4").tobytes()

    def terms(self, text: str | None) -> tuple[np.ndarray, int]:
        """Distinct terms of a whole text, none for a null or wordless one, and the number of its distinct words."""
        found = words(text)
        return np.unique(np.frombuffer(b"".join(map(self.memo.__getitem__, found)), "<u4")), len(found)


def raw_scores(machine: Machine, rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Log odds of texts given by their terms and words; interactions are averaged over a text's words."""
    sizes = np.fromiter((len(r) for r, _ in rows), np.int64, len(rows))
    full = np.flatnonzero(sizes)
    out = np.full(len(rows), machine.bias)
    if len(full):
        flat = np.concatenate([r for r, _ in rows])
        at = (np.cumsum(sizes) - sizes)[full]
        v = machine.factors[flat]
        total, squares = np.add.reduceat(v, at, axis=0), np.add.reduceat(v * v, at, axis=0)
        many = np.fromiter((n for _, n in rows), np.int64, len(rows))[full]
        out[full] += np.add.reduceat(machine.weights[flat], at) + 0.5 * (total * total - squares).sum(1) / many
    return out


def probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(places: dict[int, int], rows: list[tuple[np.ndarray, int]], labels: np.ndarray, telling: np.ndarray, seed: int = 7) -> Machine:
    """Weights of the telling terms, then vectors of all.  Without both classes, every score is their smoothed share."""
    rng = np.random.default_rng(seed)
    n = len(places)
    w, v, bias = np.zeros(n), np.zeros((n, FACTORS)), 0.0
    if not 0 < labels.sum() < len(labels):
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Machine(float(np.log(share / (1 - share))) - 1e-9, {}, w[:0], v[:0])
    sw, sb = np.full(n, 1e-6), 1e-6
    few = [(r[telling[r]], many) for r, many in rows]
    for part, (batch, used, where, owner) in _batches(few, np.arange(len(few)), EPOCHS, rng, _used):
        error = (probability(raw_scores(Machine(bias, places, w, v), batch)) - labels[part]) / len(part)
        sb += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(sb)
        gw = np.bincount(where, error[owner], len(used)) + DECAY * w[used]
        sw[used] += gw * gw
        w[used] -= RATE * gw / np.sqrt(sw[used])
    v, sv = rng.normal(0, FACTOR_START, (n, FACTORS)).astype(np.float32), np.ones((n, FACTORS), np.float32)
    some = np.array([i for i, (r, _) in enumerate(rows) if len(r)], np.int64)
    for step, (part, (flat, used, order, first, owner, at, many)) in enumerate(_batches(rows, some, FACTOR_EPOCHS, rng, _sorted)):
        shrink = FACTOR_SHRINK if step * BATCH > FREE_EPOCHS * len(some) else 0.0  # a pair takes a while to stand out
        own = v[flat]
        total = np.add.reduceat(own, at, axis=0)
        pairs = 0.5 * ((total * total).sum(1) - np.add.reduceat((own * own).sum(1), at)) / many
        error = (probability(bias + np.add.reduceat(w[flat], at) + pairs) - labels[part]) / many
        gv = np.add.reduceat((error.astype(np.float32)[owner, None] * (total[owner] - own))[order], first, axis=0)
        sv[used] += gv * gv
        new = v[used] - FACTOR_RATE * gv / np.sqrt(sv[used])
        v[used] = new * np.maximum(0, 1 - shrink / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12))
    met = np.bincount(np.concatenate([r for r, _ in rows]), minlength=n) > 0
    kept = np.flatnonzero(met & ((w != 0) | v.any(1)))
    row = {int(k): i for i, k in enumerate(kept)}
    return Machine(float(bias), {place: row[k] for place, k in places.items() if k in row}, w[kept], v[kept])


def _batches(rows: list, some: np.ndarray, epochs: int, rng: np.random.Generator, laid_out):
    """Shuffled batches of some rows: (their numbers, what ``laid_out`` makes of them); one is held at a time."""
    for _ in range(epochs):
        order = rng.permutation(some)
        for lo in range(0, len(order), BATCH):
            part = order[lo:lo + BATCH]
            yield part, laid_out([rows[i] for i in part])


def _used(batch: list[tuple[np.ndarray, int]]) -> tuple:
    """The batch, its distinct terms, each occurrence's number among them, and its text."""
    owner = np.repeat(np.arange(len(batch)), [len(r) for r, _ in batch])
    used, where = np.unique(np.concatenate([r for r, _ in batch]), return_inverse=True)
    return batch, used, where, owner


def _sorted(batch: list[tuple[np.ndarray, int]]) -> tuple:
    """Terms of a batch's texts one after the other, and the order and places in which they are summed by term and by text; every text has a term."""
    sizes = np.array([len(r) for r, _ in batch])
    flat = np.concatenate([r for r, _ in batch])
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(flat[order].astype(np.int64)) != 0)))
    owner = np.repeat(np.arange(len(batch)), sizes)
    return flat, flat[order][first], order, first, owner, np.cumsum(sizes) - sizes, np.array([m for _, m in batch], float)


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(toxic, text) of about SAMPLE_ROWS labelled documents of each class that are not held out, and the log odds to add to
    what is fitted on them: the sample has toxic over clean rows by the ratio of the two shares drawn too often.

    The draw compares a hash of the id with the share wanted, so it needs no sorting, and what
    is broadcast are the ids drawn: twice SAMPLE_ROWS by that bound.  Texts are not shuffled
    but for the sample, of which an id that occurs more than once keeps its least text.
    """
    toxic = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    there = {r["toxic"]: r["count"] for r in toxic.groupBy("toxic").count().collect()}
    clean_share, toxic_share = (min(1.0, SAMPLE_ROWS / there.get(k, 1)) for k in (0, 1))
    share = F.when(F.col("toxic") == 1, toxic_share).otherwise(clean_share)
    drawn = toxic.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * float(1 << 40))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = cut_lineage(rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text"))
    return rows, float(np.log(clean_share / toxic_share))


def _counted(batches):
    """Texts of each class that hold a term, summed over some hundred texts before they leave the task."""
    def summed(seen):
        every = [np.concatenate(s) if s else np.empty(0, np.uint32) for s in seen]
        names, where = np.unique(np.concatenate(every), return_inverse=True)
        n = [np.bincount(where[:len(every[0])], minlength=len(names)), np.bincount(where[len(every[0]):], minlength=len(names))]
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), *map(pa.array, n)], ["term", "clean", "toxic"])
    seen, size = ([], []), 0
    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = np.unique(np.array([h for w in words(text) for h in word_hashes(w)], np.uint32))
            seen[label].append(found)
            size += len(found)
            if size > 1_000_000:
                yield summed(seen)
                seen, size = ([], []), 0
    if size:
        yield summed(seen)


def _ratio(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Log-likelihood ratio of a term in a of na texts of one class and in b of nb texts of the other."""
    part = lambda k, n, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    held = (a + b) / (na + nb)
    return 2 * (part(a, na, held) + part(b, nb, held) + part(na - a, na, 1 - held) + part(nb - b, nb, 1 - held))


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """Count terms and fit on the sample; the driver gets the sample's terms and its rows as numbers of those terms."""
    rows, shift = sampled(docs, labels)
    counts = (rows.mapInArrow(_counted, "term long, clean long, toxic long").groupBy("term")
              .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_TEXTS))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n = [F.lit(float(sizes.get(k, 0) + 1)) for k in (0, 1)]
    found = counts.select("term", (_ratio(F.col("toxic"), F.col("clean"), n[1], n[0]) >= LEAST_RATIO).alias("telling")).toArrow()
    terms = found.column("term").to_numpy()
    order = np.argsort(terms)
    places = {t: i for i, t in enumerate(terms[order].tolist())}
    telling = found.column("telling").to_numpy()[order].astype(bool)
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        reader = Reader(shared.value)
        for b in batches:
            terms = [reader.terms(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.tobytes() for t, _ in terms], pa.binary()), pa.array([m for _, m in terms], pa.int64())],
                                             ["toxic", "terms", "words"])
    picked = rows.mapInArrow(run, "toxic int, terms binary, words long").toArrow()
    picked = sorted(zip(*(picked.column(c).to_pylist() for c in ("toxic", "terms", "words"))))  # so that no order of tasks matters
    machine = fit(places, [(np.frombuffer(t, "<u4"), m) for _, t, m in picked], np.array([k for k, _, _ in picked], float), telling)
    return replace(machine, bias=machine.bias + shift)


def probabilities(machine: Machine, reader: Reader, texts: list[str | None]) -> np.ndarray:
    parts = [probability(raw_scores(machine, [reader.terms(t) for t in texts[i:i + 1024]])) for i in range(0, len(texts), 1024)]
    return np.concatenate(parts) if parts else np.empty(0)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; only the text is read, a null one is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        reader = Reader(shared.value.places)
        for b in batches:
            p = probabilities(shared.value, reader, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows not predicted toxic, with all their columns; judged row by row, so ids need not be unique."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    shape = docs.select("text", *[c for c in docs.columns if c != "text"])

    def run(batches):
        reader = Reader(shared.value.places)
        for b in batches:
            yield b.filter(pa.array(probabilities(shared.value, reader, b.column(0).to_pylist()) < 0.5))
    return shape.mapInArrow(run, shape.schema).select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents.

    Labels of held-out documents are never learned; a null id is not held out and has no label;
    a document labelled twice counts once, as toxic if either says so.
    """
    return score(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
