"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words (runs of ASCII letters and non-ASCII characters, lower-cased) and of
their stems (the first 4 and 5 bytes, as many languages inflect), each hashed to 32 bits. The score
is the logistic of a bias, one weight for each term, and for each pair of terms the inner product
of their factors; so pairs such as an insult and a group mention count beyond their sum. The machine
has two kinds of terms, so that it does not learn its sample by heart: those whose own presence goes
with the label (chi-square of ``chi`` or more, on ``least`` texts or more), and those of a pair whose
common presence does (``pair_chi`` or more, on ``pair_share`` of the texts or more, and twice the
chi-square of either alone), which no linear weight could tell.

The model is fitted on a bounded sample: the ``sample`` labelled training rows whose doc_id hashes
lowest (of rows that share a doc_id, one). Only those rows' term sets reach the driver. Scoring is one
pass over the texts without a shuffle, in numpy over all words of an Arrow batch.

Edge cases: a null or empty text has no terms and gets the score of the bias. Null labels and
labels of a null doc_id are not used; if a doc_id has several labels, 1 wins. Without any training
row every score is 0; with one class only, the score follows that class's bias. Repeated rows are
scored alike; very long texts are read whole; an empty table gives an empty one. ``score`` reads
nothing but the text, keeps the other columns, and replaces any named ``score`` or ``predicted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quoteloom.llm.common import fresh, positional, strings, without

SAMPLE = 6000
LEAST = 3
CHI = 10.0
PAIR_SHARE = 0.02
PAIR_CHI = 40.0  # among millions of pairs, one by chance in a thousand samples
FACTORS = 4
STEPS = 300
BATCH = 200
STEMS = (4, 5)
DECAY = 2e-4
THRESHOLD = 0.7

AT_ONCE = 1 << 20  # words
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[128:] = True

U64 = np.uint64
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], U64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * MIX[1]
    x = (x ^ (x >> U64(29))) * MIX[2]
    return x ^ (x >> U64(32))


def words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, and the start, end and row of each word."""
    raw, at = strings(pc.utf8_lower(texts.cast(pa.large_string())))
    raw, at = raw[at[0] : at[-1]], at - at[0]
    letter = LETTER[raw]
    before, after = np.zeros_like(letter), np.zeros_like(letter)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    some = np.flatnonzero(np.diff(at))  # rows that are not empty; words end with their rows
    before[at[some]] = after[at[some + 1] - 1] = False
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    return raw, start, end, np.searchsorted(at, start, "right") - 1


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words and of their stems; ``raw`` has 8 bytes more than the last word needs."""
    eights = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))

    def part(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The next bytes, up to eight, as a number."""
        shift = (U64(8) * (U64(8) - np.minimum(size, 8).astype(U64))).astype(U64)
        return (eights[begin].astype(U64) >> shift) << shift

    size = end - start
    first = part(start, size)
    found = [_mixed((first & ~U64((1 << (64 - 8 * n)) - 1)) + U64(n)) for n in STEMS]
    whole = _mixed(first ^ MIX[0])
    at = 8
    while len(longer := np.flatnonzero(size > at)):
        whole[longer] = _mixed(whole[longer] * MIX[0] + part(start[longer] + at, size[longer] - at))
        at += 8
    return [(x >> U64(32)).astype(np.uint32) for x in (whole, *found)]


def terms(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and hashes of the terms of ``texts``, repeats included, some at a time."""
    raw, start, end, row = words(texts)
    raw = np.append(raw, np.zeros(8, np.uint8))
    for at in range(0, len(start), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        for found in _hashes(raw, start[part], end[part]):
            yield row[part], found


@dataclass
class Machine:
    """Hashes of the terms in ascending order, with the weight and factors of each."""

    known: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.known = self.known.astype(np.uint32)
        # most words are told as unknown by a few bits of their hash
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.known >> np.uint32(16)] = True

    def scores(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        found = [np.zeros(0, np.int64)]
        for row, hashes in terms(texts) if len(self.known) else ():
            few = np.flatnonzero(self.seen[hashes >> np.uint32(16)])
            at = np.minimum(np.searchsorted(self.known, hashes[few]), len(self.known) - 1)
            good = self.known[at] == hashes[few]
            found.append(np.unique(row[few[good]] * len(self.known) + at[good]))
        row, term = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.known)))
        raw = self.bias + np.bincount(row, self.weights[term], len(texts))
        for f in self.factors.T:
            f = f[term]
            raw += 0.5 * (np.bincount(row, f, len(texts)) ** 2 - np.bincount(row, f * f, len(texts)))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def _paired(rows: list[np.ndarray], counts: np.ndarray, labels: np.ndarray, chi: np.ndarray, least: int, pair_chi: float) -> np.ndarray:
    """Which of the terms are in a pair that tells the label where neither of them does.

    ``rows``: term numbers of each text; ``counts``, ``chi``: texts and chi-square of each term alone.
    """
    n, out = len(rows), np.zeros(len(chi), bool)
    frequent = np.flatnonzero((counts >= least) & (counts <= n - least))
    if len(frequent) < 2:
        return out
    number = np.full(len(chi), -1)
    number[frequent] = np.arange(len(frequent))
    held = np.zeros((n, len(frequent)), np.uint8)
    for k, r in enumerate(rows):
        held[k, number[r][number[r] >= 0]] = 1
    toxic, alone, is_toxic = labels.sum(), chi[frequent], labels > 0
    for at in range(0, len(frequent), 512):
        left = held[:, at : at + 512].astype(np.float32)
        for to in range(at, len(frequent), 512):
            right = held[:, to : to + 512].astype(np.float32)
            both = (left.T @ right).astype(np.float64)
            hits = (left[is_toxic].T @ right[is_toxic]).astype(np.float64)
            spread = both * (n - both) * toxic * (n - toxic)
            value = n * (hits * n - both * toxic) ** 2 / np.maximum(spread, 1)
            good = (both >= least) & (value >= pair_chi) & (value >= 2 * np.maximum(alone[at : at + 512, None], alone[to : to + 512]))
            a, b = np.nonzero(good)
            a, b = at + a, to + b
            out[frequent[a[a != b]]] = out[frequent[b[a != b]]] = True
    return out


def fit(texts: list[np.ndarray], labels: np.ndarray, least: int = LEAST, chi: float = CHI, pair_share: float = PAIR_SHARE, pair_chi: float = PAIR_CHI, factors: int = FACTORS, steps: int = STEPS, seed: int = 0) -> Machine:
    """Adam on the logistic loss, in batches; ``texts`` holds each text's distinct terms."""
    if not len(texts):
        return Machine(np.zeros(0, np.uint32), -40.0, np.zeros(0), np.zeros((0, factors)))
    flat = np.concatenate(texts)
    known = np.unique(flat)
    ends = np.cumsum([len(t) for t in texts])
    place = np.searchsorted(known, flat).astype(np.int32)
    del flat
    counts = np.bincount(place, minlength=len(known))
    hits = np.zeros(len(known), np.int64)
    for k in np.flatnonzero(labels > 0):  # a text holds a term once
        hits[place[ends[k] - len(texts[k]) : ends[k]]] += 1
    n, n_toxic = len(texts), labels.sum()
    spread = counts * (n - counts) * n_toxic * (n - n_toxic)
    linked = n * (hits * n - counts * n_toxic) ** 2 / np.maximum(spread, 1)
    picked = (counts >= least) & (linked >= chi)
    known = known[picked | _paired(np.split(place, ends[:-1]), counts, labels, linked, max(least, int(pair_share * n)), pair_chi)]
    rng = np.random.default_rng(seed)
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = np.log(rate / (1 - rate))
    # of the terms that searchsorted points at, those that are the text's own
    rows = []
    for t in texts:
        at = np.minimum(np.searchsorted(known, t), max(0, len(known) - 1)) if len(known) else np.zeros(0, np.int64)
        rows.append(at[known[at] == t] if len(at) else at)
    # one column more for the bias's own step; weights and factors side by side
    p = np.concatenate([np.zeros((len(known), 1)), rng.normal(0, 0.01, (len(known), factors))], axis=1)
    m, v, step = np.zeros_like(p), np.zeros_like(p), 0
    bm = bv = 0.0
    while len(known) and step < steps:
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            rate = 0.05 if step < 2 * steps // 3 else 0.01
            some = order[at : at + BATCH]
            step += 1
            sizes = np.array([len(rows[k]) for k in some])
            term = np.concatenate([rows[k] for k in some])
            if not len(term):
                continue
            row = np.repeat(np.arange(len(some)), sizes)
            x = p[term]
            full = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            total, square = np.zeros((len(some), p.shape[1])), np.zeros((len(some), p.shape[1]))
            total[full], square[full] = np.add.reduceat(x, starts), np.add.reduceat(x * x, starts)
            raw = bias + total[:, 0] + 0.5 * (total[:, 1:] ** 2 - square[:, 1:]).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[some]) / len(some)
            push = error[row][:, None] * np.concatenate([np.ones((len(term), 1)), total[row, 1:] - x[:, 1:]], axis=1)
            by = np.argsort(term, kind="stable")
            first = np.flatnonzero(np.insert(np.diff(term[by]) != 0, 0, True))
            touched = term[by][first]
            gradient = np.add.reduceat(push[by], first) + DECAY * p[touched]
            m[touched] = 0.9 * m[touched] + 0.1 * gradient
            v[touched] = 0.99 * v[touched] + 0.01 * gradient**2
            p[touched] -= rate * (m[touched] / (1 - 0.9**step)) / (np.sqrt(v[touched] / (1 - 0.99**step)) + 1e-6)
            g = error.sum()
            bm, bv = 0.9 * bm + 0.1 * g, 0.99 * bv + 0.01 * g * g
            bias -= rate * (bm / (1 - 0.9**step)) / (np.sqrt(bv / (1 - 0.99**step)) + 1e-6)
    return Machine(known, float(bias), p[:, 0].astype(np.float32), p[:, 1:].astype(np.float32))


def sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct terms of each text, in ascending order."""
    parts = list(terms(texts))
    row = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in parts)])
    found = np.concatenate([np.zeros(0, np.uint32), *(h for _, h in parts)])
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.insert((row[1:] != row[:-1]) | (found[1:] != found[:-1]), 0, True) if len(row) else np.zeros(0, bool)
    return np.split(found[new], np.searchsorted(row[new], np.arange(1, len(texts))))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            some = batch.slice(at, 256)
            found = pa.array([t.view(np.int32) for t in sets(some.column("text"))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("toxic"), found], ["doc_id", "toxic", "terms"])


def held_out(doc_id: Column) -> Column:
    """A third of the documents is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on the rows of ``labels`` (doc_id, toxic) that are not held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers are broadcast; of rows that share a doc_id one stays
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.mapInArrow(_sets, "doc_id long, toxic int, terms array<int>").toArrow().sort_by("doc_id")
    found = rows.column("terms").combine_chunks()
    flat, at = found.flatten().to_numpy().view(np.uint32), np.append(0, np.cumsum([len(x) for x in found]))
    return fit([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], rows.column("toxic").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on), under the given names."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the sample's terms
    docs = without(docs, *names)
    columns = docs.columns
    text = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.scores(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], [*columns, *names])

    schema = StructType([*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    return positional(docs).mapInArrow(run, schema)


def clean(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the toxic rows; all its columns stay as they are."""
    own = fresh(docs)
    kept = score(docs, machine, threshold, (f"{own}score", f"{own}predicted")).where(F.col(f"{own}predicted") == 0)
    return kept.drop(f"{own}score", f"{own}predicted")
