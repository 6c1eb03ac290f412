"""Removal of byte strings that also start earlier in the corpus (suffix-array dedup).

Every text counts as UTF-8 bytes. A byte goes when a string of ``length`` bytes covers it that
also starts earlier, in a smaller ``doc_id`` or before in the same document.

How the work is spread:

1. Each window of ``length`` bytes belongs to one *anchor*, the 32 bytes within it whose hash is
   least. Equal windows have equal anchors at equal offsets, so only windows under one anchor can
   be equal. Consecutive windows that share an anchor form a *segment*. A map task emits one short
   row a segment; of equal segments in its batch only the earliest is sent on, which keeps the
   rows of a passage that a third of the corpus holds to one a batch. Neighbouring segments that
   are known to repeat are one row, so a text of one byte repeated makes few.
2. The rows meet by anchor. Anchors met once are done. Equal segments (64 bits of the anchor and 96 of
   the content agree; their bytes are not fetched) leave the earliest.
3. Distinct segments under one anchor may still share some windows. Their bytes are cut from the
   documents, meet by anchor, and a two-stage suffix array (``suffix_array``) over each block puts
   equal windows next to each other: common prefix of ``length`` or more, the earliest stays. An
   anchor with over ``hot`` distinct segments is split further, to one group for each window hash.

Steps 1 and 2 lose nothing: they keep the suffix array to one copy of the bytes that can repeat. So it
decides which windows of different segments are equal, and equal segments are told by their hashes.

Edge cases: a null or empty text has no bytes; texts shorter than ``length`` keep all. A row whose
doc_id is null is compared with nothing and kept whole. Rows that repeat a doc_id and text are one
document, returned once a row. If rows share a doc_id but not a text, each is scanned on its own
and the spans of all apply to each, clipped to its length. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.common import column, strings, whole, written
from quoteloom.llm.suffix_array import common_prefixes, suffix_array, words_at

LENGTH = 100
ANCHOR = 32
PIECE = 200_000  # bytes scanned at a time; a longer text is scanned in overlapping pieces
BLOCK = 2_000_000  # bytes under one suffix array, but for an anchor's segments, which stay together
HOT = 8192  # distinct segments under one anchor
MOST = 30_000  # windows in one row

U64 = np.uint64
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U64)

SEGMENT = "anchor long, content long, check int, doc_id long, start int, windows short, known boolean"
MARK = "kind short, anchor long, doc_id long, start int, windows short"
REPEAT, DISTINCT, SPLIT = 0, 1, 2
CUT = "anchor long, doc_id long, start int, part binary"
WINDOW = "one long, two long, doc_id long, start int"
SPAN = "doc_id long, start int, windows int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    base = int(MIX[0]) | 1
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, b, U64)])) for b in (U64(base), U64(inverse)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * MIX[1]
    x = (x ^ (x >> U64(29))) * MIX[2]
    return x ^ (x >> U64(32))


class Scanner:
    """Segments of buffers of up to ``PIECE`` bytes (and a little)."""

    def __init__(self, length: int):
        self.length = length
        self.power, self.inverse = _powers(PIECE + 2 * length + 16)

    def segments(self, text: np.ndarray, ends: np.ndarray):
        """Anchor hash, content hash and check, start and number of windows of each segment.

        ``ends``: for each byte, where its piece ends; windows stay within a piece.
        """
        n, length = len(text), self.length
        if n < length:
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        words = words_at(text)
        pieces = _mixed(words)
        spots = n - ANCHOR + 1
        hashes = pieces[:spots] * MIX[0]
        for k in range(1, ANCHOR // 8):
            hashes += pieces[8 * k : 8 * k + spots] * MIX[k]
        hashes ^= hashes >> U64(31)
        bits = U64(20)
        least = ((hashes >> bits) << bits) | np.arange(spots, dtype=U64)
        span, wide = length - ANCHOR + 1, 1
        while 2 * wide <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if span > wide:
            least = np.minimum(least[: -(span - wide)], least[span - wide :])
        at = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
        valid = np.flatnonzero(np.arange(len(at)) + length <= ends[: len(at)])
        if not len(valid):
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        at = at[valid]
        first = np.flatnonzero(np.insert((at[1:] != at[:-1]) | (np.diff(valid) != 1), 0, True))
        start, windows = valid[first], np.diff(np.append(first, len(valid)))
        summed = np.concatenate([[U64(0)], np.cumsum(pieces * self.power[:n], dtype=U64)])
        last = start + windows - 1 + length - 7  # the words of a segment lie within it
        content = _mixed((summed[last] - summed[start]) * self.inverse[start] + windows.astype(U64) * MIX[4])
        pieces = (pieces ^ (pieces >> U64(31))) * MIX[3]
        np.cumsum(pieces ^ (pieces >> U64(30)), dtype=U64, out=summed[1:])
        check = ((summed[last] - summed[start]) >> U64(32)).astype(np.uint32).view(np.int32)
        return hashes[at[first]].view(np.int64), content.view(np.int64), check, start, windows


def _pieces(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, from, to) of about PIECE bytes; long texts are cut with an overlap that
    leaves each window in exactly one piece."""
    group, size = [], 0
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while b - a >= length:
            end = min(b, a + PIECE)
            if size and size + end - a > PIECE:
                yield group
                group, size = [], 0
            group.append((row, a, end))
            size += end - a
            if end == b:
                break
            a = end - length + 1
    if group:
        yield group


def _scan(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(length)
        for batch in batches:
            raw, at = strings(batch.column("text"))
            ids = column(batch, "doc_id")
            found = []
            for group in _pieces(raw, at, length):
                rows, a, b = (np.array(x, np.int64) for x in zip(*group, strict=True))
                sizes = b - a
                base = np.cumsum(sizes) - sizes
                text = np.concatenate([raw[x:y] for x, y in zip(a, b, strict=True)])
                anchor, content, check, start, windows = scanner.segments(text, np.repeat(base + sizes, sizes))
                piece = np.searchsorted(base, start, "right") - 1
                found.append((anchor, content, check, ids[rows[piece]], start - base[piece] + a[piece] - at[rows[piece]], windows))
            if not found:
                continue
            anchor, content, check, doc, start, windows = (np.concatenate(x) for x in zip(*found, strict=True))
            order, new = _sorted(anchor, content, check, doc, start)
            anchor, content, check, doc, start, windows = (x[order] for x in (anchor, content, check, doc, start, windows))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            known = (doc != doc[first]) | (start != start[first])
            keep = new & ~known
            yield _segments(*(x[keep] for x in (anchor, content, check, doc, start, windows)), False)
            # a known repeat needs no meeting, so its route is any number, and neighbours are one row
            doc, start, windows = doc[known], start[known], windows[known]
            order = np.lexsort((start, doc))
            doc, start, windows = doc[order], start[order], windows[order]
            apart = np.insert((doc[1:] != doc[:-1]) | (start[1:] != (start + windows)[:-1]), 0, True) if len(doc) else np.zeros(0, bool)
            run = np.cumsum(apart) - 1
            covered = np.cumsum(windows) - windows
            apart |= np.insert(np.diff((covered - covered[np.flatnonzero(apart)][run]) // MOST) != 0, 0, True) if len(doc) else apart
            head = np.flatnonzero(apart)
            total = np.add.reduceat(windows, head) if len(head) else windows
            route = doc[head] * 2654435761 + start[head]
            nothing = np.zeros(len(head), np.int64)
            yield _segments(route, nothing, nothing, doc[head], start[head], total, True)

    return scan


def _sorted(anchor, content, check, doc, start) -> tuple[np.ndarray, np.ndarray]:
    """Order by segment, then place, and which rows of it begin another segment."""
    order = np.lexsort((start, doc, check, content, anchor))
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (anchor, content, check):
        x = x[order]
        same &= x[1:] == x[:-1]
    return order, np.append(True, ~same)[: len(order)]


def _segments(anchor, content, check, doc, start, windows, known: bool) -> pa.RecordBatch:
    columns = (anchor, content, check.astype(np.int32), doc, start.astype(np.int32), windows.astype(np.int16), np.full(len(doc), known))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "content", "check", "doc_id", "start", "windows", "known"])


def _marks(kind, anchor, doc, start, windows) -> pa.RecordBatch:
    kinds = np.broadcast_to(np.asarray(kind, np.int16), len(doc))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(x)) for x in (kinds, anchor, doc, start.astype(np.int32), windows.astype(np.int16))],
        ["kind", "anchor", "doc_id", "start", "windows"],
    )


def _meet(hot: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = whole(batches)
        if rows is None:
            return
        anchor, content, check, doc, start, windows, known = (column(rows, c) for c in ("anchor", "content", "check", "doc_id", "start", "windows", "known"))
        if known.any():
            yield _marks(REPEAT, anchor[known], doc[known], start[known], windows[known])
        anchor, content, check, doc, start, windows = (x[~known] for x in (anchor, content, check, doc, start, windows))
        order = np.argsort(anchor, kind="stable")
        sorted_anchor = anchor[order]
        same = sorted_anchor[1:] == sorted_anchor[:-1]
        order = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
        if not len(order):
            return
        anchor, content, check, doc, start, windows = (x[order] for x in (anchor, content, check, doc, start, windows))
        order, new = _sorted(anchor, content, check, doc, start)
        anchor, doc, start, windows = (x[order] for x in (anchor, doc, start, windows))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        repeat = (doc != doc[first]) | (start != start[first])
        if repeat.any():
            yield _marks(REPEAT, anchor[repeat], doc[repeat], start[repeat], windows[repeat])
        head = np.flatnonzero(new)
        group = np.cumsum(np.insert(anchor[head][1:] != anchor[head][:-1], 0, True)) - 1
        size = np.bincount(group)[group]
        head, size = head[size > 1], size[size > 1]
        if len(head):
            yield _marks(np.where(size > hot, SPLIT, DISTINCT), anchor[head], doc[head], start[head], windows[head])

    return meet


def _cut(length: int):
    """Bytes of each wanted segment."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = strings(batch.column("text"))
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(len(batch)), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            anchor, start, windows = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "start", "windows"))
            a = at[row] + start
            b = np.minimum(a + windows + length - 1, at[row + 1])
            for x in range(0, len(row), 20_000):
                some = slice(x, x + 20_000)
                parts = [raw[i:j].tobytes() for i, j in zip(a[some], b[some], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[some]), pa.array(column(batch, "doc_id")[row[some]]), pa.array(start[some]), pa.array(parts, pa.binary())], ["anchor", "doc_id", "start", "part"])

    return cut


def repeats_in_block(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int):
    """(doc_id, start, windows) runs of the windows of ``parts`` that occur earlier among them."""
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(b"".join(parts), np.uint8)
    base = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(parts)), sizes)
    order = suffix_array(text, length)
    order = order[order + length <= (base + sizes)[part[order]]]
    near = common_prefixes(words_at(text), order, length) >= length
    group = np.cumsum(~near)
    d, s = doc[part[order]], start[part[order]] + order - base[part[order]]
    by = np.lexsort((s, d, group))
    group, d, s, order = group[by], d[by], s[by], order[by]
    new = np.insert(group[1:] != group[:-1], 0, True) if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(group) else np.zeros(0, np.int64)
    at = np.sort(order[(d != d[first]) | (s != s[first])])
    if not len(at):
        return at, at, at
    run = np.flatnonzero(np.insert((np.diff(at) != 1) | (part[at[1:]] != part[at[:-1]]), 0, True))
    p = part[at[run]]
    return doc[p], start[p] + at[run] - base[p], np.diff(np.append(run, len(at)))


def _suffix_sorted(length: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = whole(batches)
        if rows is None:
            return
        anchor = column(rows, "anchor")
        order = np.argsort(anchor, kind="stable")
        anchor = anchor[order]
        rows = rows.take(pa.array(order))
        doc, start = column(rows, "doc_id"), column(rows, "start").astype(np.int64)
        sizes = np.diff(strings(rows.column("part"))[1])
        heads = np.append(np.flatnonzero(np.insert(anchor[1:] != anchor[:-1], 0, True)), len(anchor))
        filled = np.append(0, np.cumsum(sizes))[heads]
        a = 0
        while a < len(heads) - 1:
            b = max(a + 1, int(np.searchsorted(filled, filled[a] + BLOCK, "right")) - 1)
            some = slice(int(heads[a]), int(heads[b]))
            d, s, w = repeats_in_block(rows.column("part")[some].to_pylist(), doc[some], start[some], length)
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(w.astype(np.int32))], ["doc_id", "start", "windows"])
            a = b

    return sort


def _window_hashes(length: int):
    """128 bits of hash for each window of the segments of split anchors."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, doc, start, part in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "start", "part")), strict=True):
                pieces = _mixed(words_at(np.frombuffer(part, np.uint8)))
                n = len(part) - length + 1
                power, inverse = _powers(len(part))
                at = np.arange(n)
                summed = np.concatenate([[U64(0)], np.cumsum(pieces * power[: len(part)], dtype=U64)])
                two = _mixed((summed[at + length - 7] - summed[at]) * inverse[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(two.view(np.int64)), pa.array(np.full(n, doc)), pa.array((start + at).astype(np.int32))], ["one", "two", "doc_id", "start"])

    return hashes


def _keep(length: int):
    """Text without its spans."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = strings(batch.column("text"))
            spans = batch.column("spans")
            row = np.repeat(np.arange(len(batch)), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            n = np.diff(at)
            a = np.minimum(flat.field("start").to_numpy(zero_copy_only=False), n[row])
            b = np.minimum(a + flat.field("windows").to_numpy(zero_copy_only=False) + length - 1, n[row])
            order = np.lexsort((a, row))
            row, a, b = row[order], a[order], b[order]
            place = (at[:-1] - at[0] + np.arange(len(batch)))[row]  # a gap between texts
            reach = np.maximum.accumulate(b + place) if len(b) else b
            new = np.flatnonzero(np.insert(a[1:] + place[1:] > reach[:-1], 0, True)) if len(a) else a
            row, a, b = row[new], a[new], (reach[np.append(new[1:], len(reach)) - 1] - place[new]) if len(new) else a
            full = b > a
            row, a, b = row[full], a[full], b[full]
            counts = np.bincount(row, minlength=len(batch))
            removed = np.bincount(row, b - a, len(batch)).astype(np.int64)
            where = np.append(0, np.cumsum(counts))
            kept = []
            for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                here = slice(where[i], where[i + 1])
                cuts = np.concatenate([[0], np.column_stack([a[here], b[here]]).ravel(), [y - x]]) + x
                kept.append(b"".join(raw[cuts[k] : cuts[k + 1]].tobytes() for k in range(0, len(cuts), 2)))
            runs = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["start", "end"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(removed), pa.array(counts.astype(np.int64)), runs, pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return keep


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (maximal removed byte runs), kept (bytes)."""
    if length < ANCHOR + 8:
        raise ValueError(f"length must be {ANCHOR + 8} or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    marks = written(known.mapInArrow(_scan(length), SEGMENT).repartition("anchor").mapInArrow(_meet(hot), MARK))

    wanted = marks.where(F.col("kind") > REPEAT).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "anchor", "start", "windows")).alias("wanted"))
    cut = docs.join(wanted.hint("shuffle_hash"), "doc_id")
    only = lambda kind: cut.withColumn("wanted", F.filter("wanted", lambda w: w["kind"] == kind)).where(F.size("wanted") > 0).mapInArrow(_cut(length), CUT)
    spans = marks.where(F.col("kind") == REPEAT).select("doc_id", "start", F.col("windows").cast("int").alias("windows"))
    spans = spans.unionByName(only(DISTINCT).repartition("anchor").mapInArrow(_suffix_sorted(length), SPAN))
    if not marks.where(F.col("kind") == SPLIT).isEmpty():
        windows = only(SPLIT).mapInArrow(_window_hashes(length), WINDOW)
        first = windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start")).alias("first"))
        later = windows.join(first, ["one", "two"]).where(F.struct("doc_id", "start") > F.col("first"))
        spans = spans.unionByName(later.select("doc_id", "start", F.lit(1).alias("windows")))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    joined = docs.join(spans.hint("shuffle_hash"), "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,windows:int>>")))
    return joined.mapInArrow(_keep(length), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
