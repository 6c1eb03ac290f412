"""SimHash fingerprints linked at 2 or fewer differing bits, by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut in segments of 23, 23 and 18 bits. With two errors or fewer, some pair
of segments has at most one between them: one segment of that pair is equal and the other within
one bit. So the keys of a fingerprint are, for each ordered pair, the exact first segment with
each nearby codeword index of the second (``golay``): 32 keys on average, linear in the input.
Equal fingerprints are one row before that. Rows of a key are compared in place; over ``CROWD``
under one key are instead linked through their 65 variants (itself, and each bit flipped): two
fingerprints within two bits share a variant. Keys of over ``hot`` fingerprints go through such
variants as rows of their own, which deals them over all tasks; any variant has at most 65 owners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm import golay
from quoteloom.llm.common import column, fresh, whole, written
from quoteloom.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = ((0, 23), (23, 23), (46, 18))
CROWD = 64
HOT = 20_000

U64 = np.uint64
KEY = "key long, fingerprint long"
LINK = "one long, two long"


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text: words by ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), U64, len(words) - shingle + 1)
    return signature(hashes)


def signature(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit ``hashes``, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_prints = column(batch, "fingerprint")
        for at in range(0, len(all_prints), 4096):
            prints = all_prints[at : at + 4096]
            parts = [((prints.view(U64) >> U64(a)) & U64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
            near = [golay.keys(p) for p in parts]
            rows, keys = [], []
            for family, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if x != y):
                row, index = near[y]
                rows.append(row)
                keys.append((family << 35) | (parts[x][row] << 12) | index)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(prints[np.concatenate(rows)])], ["key", "fingerprint"])


def _variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flips = np.append(U64(0), U64(1) << np.arange(64, dtype=U64))
    return (prints.view(U64)[:, None] ^ flips).view(np.int64).ravel(), np.repeat(prints, len(flips))


def _chained(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between neighbours of equal group."""
    order = np.argsort(group, kind="stable")
    group, prints = group[order], prints[order]
    same = group[1:] == group[:-1]
    return prints[:-1][same], prints[1:][same]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = whole(batches)
    if rows is None:
        return
    key, prints = column(rows, "key"), column(rows, "fingerprint")
    order = np.argsort(key, kind="stable")
    key, prints = key[order], prints[order]
    heads = np.append(np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True)), len(key))
    size = np.diff(heads)
    ones, twos = [], []
    crowded = np.repeat(size > CROWD, size)
    few_key, few = key[~crowded], prints[~crowded]
    for step in range(1, min(CROWD, int(size.max()))):
        same = np.flatnonzero(few_key[step:] == few_key[:-step])
        if not len(same):
            break
        near = np.bitwise_count((few[same] ^ few[same + step]).view(U64)) <= DISTANCE
        ones.append(few[same][near])
        twos.append(few[same + step][near])
    for k in np.flatnonzero(size > CROWD):
        mine = prints[heads[k] : heads[k + 1]]
        variant, owner = _variants(mine)
        one, two = _chained(variant, owner)
        ones.append(one)
        twos.append(two)
    if ones:
        pairs = np.unique(np.column_stack([np.concatenate(ones), np.concatenate(twos)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["one", "two"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = column(batch, "fingerprint")
        for at in range(0, len(prints), 4096):
            variant, owner = _variants(prints[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(variant), pa.array(owner)], ["key", "fingerprint"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = whole(batches)
    if rows is None:
        return
    one, two = _chained(column(rows, "key"), column(rows, "fingerprint"))
    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["one", "two"])


def linked(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (one, two) that join distinct ``fingerprint`` rows within 2 bits, enough of them for
    the components of all such pairs."""
    keys = prints.select("fingerprint").mapInArrow(_keys, KEY)
    crowds = written(keys.groupBy("key").count().where(F.col("count") > hot).select("key"))
    if crowds.isEmpty():
        return keys.repartition("key").mapInArrow(_link, LINK)
    # the crowds' keys are at most 1/hot of all keys
    in_crowds = keys.join(crowds, "key", "left_semi").select("fingerprint").distinct()
    spread = in_crowds.mapInArrow(_spread, KEY).repartition("key").mapInArrow(_chain, LINK)
    return keys.join(crowds, "key", "left_anti").repartition("key").mapInArrow(_link, LINK).unionByName(spread)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (long), component_id (smallest doc_id reachable by links) of each row.

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like others.
    Repeated rows have equal fingerprints. A null doc_id is returned but never names a component
    unless all of its component are null (then component_id is null). Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = written(docs.mapInArrow(_fingerprints(shingle), "doc_id long, fingerprint long"))
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    links = written(linked(distinct, hot))
    # ends by print: a print whose rows have no doc_id still joins others
    tree = components(links)
    placed = distinct.join(tree, distinct["fingerprint"] == tree["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def first_rows(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of ``docs`` of each component that ``find`` names.

    ``find`` takes rows (doc_id, text) and returns doc_id and component_id. It is given row numbers as
    ids, so rows that share a doc_id, or have none, are documents of their own. Of a component the row
    of the smallest doc_id stays (then of the text that hashes lowest; one without a doc_id only where
    none has one). All columns stay, of any name and type.
    """
    own = fresh(docs)
    row = f"{own}row"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = find(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("at"), "component_id")
    ids = numbered.select(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("mark"), row)
    first = F.min(F.struct("unnamed", "doc_id", "mark", row))
    kept = found.join(ids, F.col("at") == F.col(row)).groupBy("component_id").agg(first.alias("first")).select(F.col("first")[row].alias(f"{own}kept"))
    return numbered.join(kept, F.col(row) == F.col(f"{own}kept"), "left_semi").drop(row)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each component of near fingerprints (see ``first_rows``)."""
    return first_rows(docs, lambda rows: near_duplicates(rows, shingle, hot))
