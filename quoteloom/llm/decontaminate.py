"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased. A document and an item are aligned word by
word: match +1, other word or gap -1, best local score divided by the item's words. Pairs of ``score`` or more are leaks.

No such pair is missed. An alignment of M matches and E errors has at most E + 1 runs of matches, so M - E - 1 or more of the
item's word pairs (neighbouring words) are intact in the document: S - 1 for a score of S words. So any S - 1 pairs hold one
that is not among the S - 2 most frequent pairs of the item. Those others, the rarest by documents of the whole corpus, are
its seeds: every item has some, however many documents copy it. The words around a seed are aligned if they hold S - 1 of the
item's pairs. An item of one or two words is found where all of it stands.

Items go through in blocks of ``block``; a block's words and pairs are broadcast, and the corpus
is read twice for each block (counts, then seeds and alignment). Nothing of the corpus is shuffled
but one count for each word pair of the block and batch. A task holds one Arrow batch of texts.

Edge cases: null or empty texts and items without words match nothing. Of items with equal ids,
each is compared. Repeated documents are each reported. Rows with a null doc_id or item_id are
reported under null. An empty table gives no pairs. ``clean`` keeps all columns, of any name and
type; ``leaks`` reads doc_id and text only.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.common import positional

NGRAM = 2
SCORE = 0.5
BLOCK = 5000
AT_ONCE = 256  # alignments of one item side by side

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
U64 = np.uint64
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], U64)
PAIR = "doc_id long, item_id long, seeds int, score double"


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` word numbers from each place on; 0 where one is unknown (-1)."""
    if len(ids) < n:
        return np.zeros(0, U64)
    out, known = np.zeros(len(ids) - n + 1, U64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        some = ids[k : k + len(out)]
        out += (some.astype(U64) + U64(1)) * FACTORS[k]
        known &= some >= 0
    out ^= out >> U64(29)
    return np.where(known, out | U64(1), U64(0))


@dataclass
class Items:
    """A block of test items: word numbers, and the n-grams of each length (pairs, or the word of an
    item of one word) in sorted order; ``need`` of an item's n-grams must stand in a passage."""

    names: list
    vocabulary: dict[bytes, int]
    texts: list[np.ndarray]
    need: np.ndarray
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list, score: float) -> Items:
        vocabulary: dict[bytes, int] = {}
        names, texts = [], []
        for name, text in rows:
            if numbers := [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]:
                names.append(name)
                texts.append(np.array(numbers))
        out = cls(names, vocabulary, texts, np.array([max(1, math.ceil(score * len(t) - 1e-9) - 1) for t in texts], np.int64))
        for length in sorted({min(NGRAM, len(t)) for t in texts}):
            keys, owners, places = [], [], []
            for k, t in enumerate(texts):
                if min(NGRAM, len(t)) == length:
                    g = grams(t, length)
                    keys.append(g)
                    owners.append(np.full(len(g), k))
                    places.append(np.arange(len(g)))
            keys, owners, places = map(np.concatenate, (keys, owners, places))
            order = np.argsort(keys, kind="stable")
            out.found[length] = keys[order], owners[order], places[order]
        return out

    def numbers(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))

    def keep(self, length: int, chosen: np.ndarray) -> None:
        self.found[length] = tuple(x[chosen] for x in self.found[length])


def _counts(shared):
    """Documents of each n-gram, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        every = {length: np.unique(keys) for length, (keys, _, _) in items.found.items()}
        for batch in batches:
            total = {length: np.zeros(len(keys), np.int64) for length, keys in every.items()}
            for t in batch.column("text"):
                ids = items.numbers(t.as_py())
                for length, keys in every.items():
                    g = grams(ids, length)
                    g = g[g > 0]
                    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                    total[length][np.unique(at[keys[at] == g])] += 1
            for length, docs in total.items():
                if len(some := np.flatnonzero(docs)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), length), pa.int32()), pa.array(every[length][some].view(np.int64)), pa.array(docs[some])], ["length", "gram", "docs"])

    return run


def align(docs: list[np.ndarray], item: np.ndarray) -> np.ndarray:
    """Best local alignment score of each word sequence with ``item`` (match 1, else -1)."""
    longest, m = max(map(len, docs)), len(item)
    text = np.full((len(docs), longest), -2)
    for k, d in enumerate(docs):
        text[k, : len(d)] = d
    before, best = np.zeros((len(docs), m + 1), np.int32), np.zeros(len(docs), np.int32)
    slope = np.arange(m + 1, dtype=np.int32)
    for j in range(longest):
        now = np.zeros_like(before)
        match = np.where(text[:, j : j + 1] == item, 1, -1)
        np.maximum(before[:, :-1] + match, before[:, 1:] - 1, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps within the row
        np.maximum(best, now.max(axis=1), out=best)
        before = now
    return best


def _pairs(items: Items, texts: list[str | None], least: float) -> list[tuple[int, int, int, float]]:
    """(text, item, seeds, score) of each leak among ``texts``."""
    by_item: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for row, t in enumerate(texts):
        ids = items.numbers(t)
        hits = []
        for length, (keys, owners, places) in items.found.items():
            g = grams(ids, length)
            at = np.flatnonzero(g)
            a, b = np.searchsorted(keys, g[at]), np.searchsorted(keys, g[at], "right")
            at, a, size = at[b > a], a[b > a], (b - a)[b > a]
            if not len(at):
                continue
            entry = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hits.append(np.column_stack([owners[entry], np.repeat(at, size), places[entry]]))
        if not hits:
            continue
        hits = np.concatenate(hits)
        for k in np.unique(hits[:, 0]):
            mine = hits[hits[:, 0] == k]
            m = len(items.texts[k])
            own = grams(items.texts[k], min(NGRAM, m))
            # an alignment through the seed lies within: it has at most m words that the item lacks
            start = mine[:, 1] - mine[:, 2] - m - 2
            for a, b, n in _joined(start, start + 3 * m + 4):
                piece = ids[max(0, a) : b]
                if np.isin(own, grams(piece, min(NGRAM, m))).sum() >= items.need[k]:
                    by_item.setdefault(int(k), []).append((row, n, piece))
    best: dict[tuple[int, int], tuple[int, float]] = {}
    for k, places in by_item.items():
        places.sort(key=lambda p: len(p[2]))
        for at in range(0, len(places), AT_ONCE):
            some = places[at : at + AT_ONCE]
            for (row, n, _), got in zip(some, align([p[2] for p in some], items.texts[k]) / len(items.texts[k]), strict=True):
                seeds, high = best.get((row, k), (0, 0.0))
                best[row, k] = seeds + n, max(high, float(got))
    return [(row, k, n, s) for (row, k), (n, s) in sorted(best.items()) if s >= least]


def _leaks(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            if good := _pairs(items, batch.column("text").to_pylist(), least):
                row, k, n, s = zip(*good, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array([items.names[x] for x in k], pa.int64()), pa.array(n, pa.int32()), pa.array(s, pa.float64())], ["doc_id", "item_id", "seeds", "score"])

    return run


def _without(shared, least: float, columns: list[str]):
    text = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            keep[[row for row, *_ in _pairs(shared.value, batch.column(text).to_pylist(), least)]] = False
            yield batch.rename_columns(columns).filter(pa.array(keep))

    return run


def _joined(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Overlapping ranges joined: start, end, how many."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    new = np.flatnonzero(np.insert(starts[1:] > np.maximum.accumulate(ends)[:-1], 0, True))
    for a, b in zip(new, np.append(new[1:], len(starts)), strict=True):
        yield int(starts[a]), int(ends[a:b].max()), int(b - a)


def _blocks(docs: DataFrame, benchmark: DataFrame, score: float, block: int) -> Iterator[Broadcast]:
    """The items in blocks, each with its seeds chosen by the counts in ``docs``."""
    spark = docs.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-benchmark.count() // block))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        # about ``block`` items, whatever the benchmark's size
        items = Items.of([(r["item_id"], r["text"]) for r in benchmark.where(part == b).orderBy("item_id", "text").collect()], score)
        if not items.texts:
            continue
        shared = spark.sparkContext.broadcast(items)
        counted = docs.select("text").mapInArrow(_counts(shared), "length int, gram long, docs long").groupBy("length", "gram").agg(F.sum("docs").alias("docs")).collect()
        counts = {(r["length"], r["gram"] & 0xFFFFFFFFFFFFFFFF): r["docs"] for r in counted}
        for length, (keys, owners, places) in list(items.found.items()):
            seen = np.array([counts.get((length, int(k)), 0) for k in keys])
            order = np.lexsort((places, seen, owners))
            owner = owners[order]
            first = np.flatnonzero(np.insert(owner[1:] != owner[:-1], 0, True))
            size = np.diff(np.append(first, len(owner)))
            rank = np.empty(len(keys), np.int64)
            rank[order] = np.arange(len(keys)) - np.repeat(first, size)
            # all but the need - 1 most frequent n-grams of each item
            most = np.zeros(len(items.texts), np.int64)
            most[owner[first]] = size - items.need[owner[first]] + 1
            items.keep(length, rank < most[owners])
        yield spark.sparkContext.broadcast(items)


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, seeds (shared seed places) and score (0 to 1) of each leak."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [docs.mapInArrow(_leaks(shared, score), PAIR) for shared in _blocks(docs, benchmark, score, block)]
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], PAIR)


def clean(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, block: int = BLOCK) -> DataFrame:
    """``docs`` without the documents that leak."""
    kept = docs
    for shared in _blocks(docs, benchmark, score, block):
        kept = positional(kept).mapInArrow(_without(shared, score, docs.columns), docs.schema)
    return kept
