"""Two-stage suffix sorting of one block of bytes, in numpy.

Only suffixes smaller than their successors are sorted by comparing bytes. Every other suffix
is induced: a scan of the buckets (one per first byte) in order puts the predecessor of each
suffix it meets at the head of the predecessor's bucket. Adjacent common prefixes follow.
Comparisons end after ``depth`` bytes, so suffixes equal that far may stand in any order.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def words_at(text: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte word that starts at each byte; zeros follow the end."""
    w = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    for step in (1, 2, 4):
        w = (w[:-step] << U64(8 * step)) | w[step:]
    return w[: len(text)]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (the last one counts as smaller)."""
    n = len(text)
    up, down = text[:-1] < text[1:], text[:-1] > text[1:]
    # within a run of one byte the comparison at the end of the run decides
    decided = np.append(np.where(up | down, np.arange(n - 1), n - 1), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return np.append(up, True)[decided]


def direct_order(words: np.ndarray, picked: np.ndarray, depth: int) -> np.ndarray:
    """``picked`` positions by their next ``depth`` bytes, eight at a time, ties only further on."""
    n = len(words)
    order = picked[np.argsort(words[picked], kind="stable")]
    keys = words[order]
    group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    for at in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        if not len(tied):
            break
        further = order[tied] + at
        key = np.where(further < n, words[np.minimum(further, n - 1)], U64(0))
        resorted = np.lexsort((key, group[tied]))
        order[tied], key = order[tied][resorted], key[resorted]
        new = np.zeros(len(order), bool)
        new[1:] = ~same
        inner = np.flatnonzero((key[1:] != key[:-1]) & (group[tied][1:] == group[tied][:-1]))
        new[tied[inner + 1]] = True
        group = np.cumsum(new)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes of ``text`` (uint8), in the order of their first bytes."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    words, small = words_at(text), smaller_than_next(text)
    direct = direct_order(words, np.flatnonzero(small), depth)
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    direct_sizes = np.bincount(text[direct], minlength=256)
    direct_ends = np.cumsum(direct_sizes)
    out = np.full(n, -1, np.int64)

    def induce(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        first = text[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        counts = np.bincount(first, minlength=256)
        starts = np.cumsum(counts) - counts
        out[heads[first] + np.arange(len(first)) - starts[first]] = before
        np.add(heads, counts, out=heads)

    for c in np.flatnonzero(sizes):
        done = ends[c] - sizes[c]
        while done < heads[c]:  # a run of c goes on within its own bucket
            block, done = out[done : heads[c]], heads[c]
            induce(block)
        block = direct[direct_ends[c] - direct_sizes[c] : direct_ends[c]]
        out[ends[c] - len(block) : ends[c]] = block
        induce(block)
    return out


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` and the one before it, up to
    ``depth`` (0 for the first)."""
    n = len(words)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        if not len(live):
            break
        a, b = order[live] + at, order[live - 1] + at
        diff = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        equal = (diff == 0) & (a < n) & (b < n)
        lead = np.zeros(len(live), np.int64)
        for k in range(7):
            lead += (diff >> U64(8 * (7 - k) - 0)) == 0
        out[live] = np.minimum(at + np.where(equal, 8, np.where((a < n) & (b < n), lead, 0)), depth)
        live = live[equal]
    return out
