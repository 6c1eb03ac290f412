"""License scan: set phrases, and an exact set-similarity join of text blocks with notices.

A block for a notice of n words is any run of up to ``STRETCH`` x n words of a text, wherever it
starts and whatever lines or paragraphs it runs over. A block meets the notice when it holds
``threshold`` of the notice's distinct words or more (containment). The join:

* every notice's words are ordered by how many documents of the whole corpus hold them, rarest
  first (one count for each notice word and task is shuffled);
* prefix filter: a text that misses the first |T| - t + 1 words of notice T, where t words are
  needed, has no block that meets it;
* length filter: neither has a text of fewer than t distinct words;
* positional filter: nor one whose first found word stands so late in T that too few are left.

In what passes, the distinct words of T in every block are counted exactly, by one sweep over the
places of T's words. Blocks of one stretch are reported as one, where it holds most. Where blocks of
notices with different labels overlap, the one that is contained best (then the one of more words)
gives its label, so a notice that holds nearly all the words of another is not taken for both. Blocks are
taken best first, so one that loses to no block that stays keeps its label.

The notices are a short table (``NOTICES`` or one's own), so they go to every task and the corpus is
never shuffled.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. Edge cases:
null and empty texts have no words and no labels. Repeated rows are scanned alike. Only doc_id and
text are read, whatever other columns are called. An empty table gives an empty result. A notice
without words meets nothing.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
STRETCH = 2
MOST_WORDS = 100_000  # of all notices together, as they go to every task

# The phrases and labels that must be found, word for word.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Customary license notices.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,start:int,end:int,containment:double>>"


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


class Notices:
    """Notices with their words in the order of the corpus's frequencies."""

    def __init__(self, notices: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.sets, self.by_prefix, self.need, self.reach = [], {}, [], []
        for label, text in notices:
            words = WORD.findall(lowered(text))
            if not words:
                continue
            order = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            for w in order[: len(order) - need + 1]:
                self.by_prefix.setdefault(w, []).append(len(self.sets))
            self.sets.append((label, {w: i for i, w in enumerate(order)}))
            self.need.append(need)
            self.reach.append(STRETCH * len(words))
        self.prefixes = frozenset(self.by_prefix)

    def met(self, words: list[bytes], held: set[bytes]) -> list[tuple[str, int, int, float, int]]:
        """Label, first word, end, containment and found words of each block that meets a notice."""
        out = []
        for k in sorted({k for w in held & self.prefixes for k in self.by_prefix[w]}):
            (label, order), need = self.sets[k], self.need[k]
            if len(held) < need:
                continue
            found = held & order.keys()
            if len(order) - min(order[w] for w in found) < need or len(found) < need:
                continue
            numbers = np.fromiter((order.get(w, -1) for w in words), np.int64, len(words))
            at = np.flatnonzero(numbers >= 0)
            out += [(label, a, b, count / len(order), count) for a, b, count in dense(at, numbers[at], self.reach[k], need)]
        return out

    @staticmethod
    def labels(met: list[tuple[str, int, int, float, int]]) -> set[str]:
        """Labels of the blocks that stay, taken best first: a block falls to a better one of another
        label that it overlaps and that has stayed itself."""
        longest = max((m[2] - m[1] for m in met), default=0)
        kept: list[tuple[int, int, str, tuple]] = []  # by start
        for label, start, end, *worth in sorted(met, key=lambda m: (*(-w for w in m[3:]), m[1], m[0])):
            near = kept[bisect.bisect_left(kept, (start - longest,)) : bisect.bisect_left(kept, (end,))]
            if not any(name != label and start < until and tuple(worth) < better for _, until, name, better in near):
                bisect.insort(kept, (start, end, label, tuple(worth)))
        return {label for _, _, label, _ in kept}


def dense(at: np.ndarray, number: np.ndarray, reach: int, need: int) -> list[tuple[int, int, int]]:
    """Start, end and distinct numbers of each stretch whose runs of ``reach`` words hold ``need`` or
    more of them, where it holds most. ``at`` (ascending) are the places of the numbers."""
    if len(at) < need:
        return []
    # a number counts in the runs that end from its place on, until it leaves or occurs again
    order = np.lexsort((at, number))
    until = at + reach
    again = number[order][1:] == number[order][:-1]
    until[order[:-1][again]] = np.minimum(until[order[:-1][again]], at[order[1:][again]])
    ends, back = np.unique(np.concatenate([at, until]), return_inverse=True)
    count = np.cumsum(np.bincount(back, np.repeat([1, -1], len(at)), len(ends))).astype(np.int64)
    full = count >= need
    edge = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]])))
    out = []
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        best = a + int(count[a:b].argmax())
        start = at[np.searchsorted(at, ends[best] - reach, "right")]
        out.append((int(start), int(ends[best]) + 1, int(count[best])))
    return out


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Word numbers at which ``phrase`` starts."""
    out, at, n = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


def _frequencies(vocabulary: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for t in batch.column("text"):
                total.update(vocabulary.intersection(WORD.findall(lowered(t.as_py()))))
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "docs"])

    return run


def _scan(notices: Notices, phrases: list[tuple[list[bytes], str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                low = lowered(t.as_py())
                words = WORD.findall(low)
                held = set(words)
                starts, base = [], set()
                for phrase, label in phrases:
                    if held.issuperset(phrase) and (found := places(words, phrase)):
                        starts += found
                        base.add(label)
                met = notices.met(words, held) if held & notices.prefixes else []
                score = max([1.0] * bool(base) + [m[3] for m in met], default=0.0)
                labels = base | notices.labels(met)
                met = [dict(zip(("label", "start", "end", "containment"), m[:4], strict=True)) for m in met]
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, met))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return run


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks (the
    label, first word, end and containment of each notice met)."""
    notices, phrases = NOTICES if notices is None else notices, PHRASES if phrases is None else phrases
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = frozenset(w for _, text in notices for w in WORD.findall(lowered(text)))
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"the notices hold over {MOST_WORDS} words; scan with a part of them at a time")
    counted = docs.mapInArrow(_frequencies(vocabulary), "word binary, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    table = Notices(notices, {bytes(r["word"]): r["docs"] for r in counted}, threshold)
    wanted = [(WORD.findall(lowered(p)), label) for p, label in phrases.items()]
    return docs.mapInArrow(_scan(table, wanted), FOUND)
