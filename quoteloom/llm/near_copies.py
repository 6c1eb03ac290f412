"""Near copies: SimHash near-dedup at a similarity that fingerprints alone cannot reach.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of ``LEAST``
or more. Words are split by ASCII white space, with A-Z lower-cased; a shorter text is one shingle.
Texts of equal shingle sets are one row. Candidates come in two ways, and every candidate pair is
verified on the whole shingle sets, by 32 bits of hash for each shingle:

* 64-bit SimHash fingerprints of the shingles, linked within 2 bits through the Golay keys of
  ``simhash.linked``;
* MinHash keys. At a similarity of 0.8 fingerprints differ by 10 bits on average (7 to 14 measured on
  edited copies), beyond what Golay-decoded segments can find at a bearable number of keys, while two
  such texts share one of BANDS keys of ROWS minima each with a probability of 1 - (1 - s^5)^25, over
  0.9999 at s = 0.8.

Under a MinHash key of up to CROWD texts, all pairs are tried. Under a larger one every text is first
tried with one text of the key, drawn anew for each key, so a group of near copies becomes few
components by few pairs; then the texts outside the largest component of the key are compared with
all of the key by their minima, and pairs in different components that agree on CLOSE of them (fewer are
agreed on with a probability of 1e-7 at 0.8) are verified where they stand, until the components they are
in are one. For that step a key is dealt in blocks of ``BLOCK`` texts against chunks of as many, each with
its minima and set, so no task holds more, however many texts a key has, and what comes out are links
between components, not pairs; its time is quadratic where a large key holds unlike texts.

Edge cases: null, empty and blank texts have no shingles and are copies of each other. Repeated rows
are copies. Only doc_id and text are read; ``one_of_each`` keeps all columns, of any name and type.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.common import written
from quoteloom.llm.components import components
from quoteloom.llm.simhash import first_rows, linked, signature

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 25, 5
CROWD = 16
BLOCK = 4096
CLOSE = 75  # of BANDS * ROWS minima
SEED = 42

U64 = np.uint64
_RNG = np.random.default_rng(SEED)
TURNS = _RNG.integers(0, 2**64, BANDS * ROWS, U64)
FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, U64) | U64(1)
MIX = _RNG.integers(0, 2**64, max(SHINGLE, ROWS), U64) | U64(1)
MARKS = "doc_id long, digest long, fingerprint long, size int, keys array<long>, minima binary"
SETS = "digest long, shingles binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), U64, len(words))
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, n, U64)
    for k in range(n):
        out += hashes[k : k + len(out)] * MIX[k]
    return np.unique(_mixed(out))


def minima(found: np.ndarray) -> np.ndarray:
    least = np.full(len(TURNS), 2**64 - 1, U64)
    for at in range(0, len(found), 4096):
        np.minimum(least, ((found[at : at + 4096, None] ^ TURNS) * FACTORS).min(axis=0), out=least)
    return least


def digest(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - 2**63


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of each shingle, enough to compare two sets."""
    for batch in batches:
        found = [shingles(t.as_py()) for t in batch.column("text")]
        few = [np.unique((f >> U64(32)).astype(np.uint32)).tobytes() for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(map(digest, found), pa.int64()), pa.array(few, pa.binary())], ["digest", "shingles"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, prints, sizes, keys, least = [], [], [], [], []
        for t in batch.column("text"):
            found = shingles(t.as_py())
            digests.append(digest(found))
            prints.append(signature(found))
            sizes.append(len(found))
            if not len(found):
                keys.append([])
                least.append(b"")
                continue
            m = minima(found)
            bands = _mixed((m.reshape(BANDS, ROWS) * MIX[:ROWS]).sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64))
            keys.append(bands.view(np.int64))
            least.append(_mixed(m).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(least, pa.binary())],
            ["doc_id", "digest", "fingerprint", "size", "keys", "minima"],
        )


def _are_alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= LEAST * max(len(a), len(b)) - 1e-9 else 0
    return both >= LEAST * (len(a) + len(b) - both) - 1e-9


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [_are_alike(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
        yield batch.select(["one", "two"]).filter(pa.array(good, pa.bool_()))


def _between(key, probes: pa.Table, others: pa.Table) -> pa.Table:
    """Verified links of a probe and another text that join components which are not joined yet."""
    found: list[tuple[int, int]] = []
    if len(probes) and len(others):
        digest, root = (probes.column(c).to_numpy() for c in ("digest", "root"))
        digests, roots = (others.column(c).to_numpy() for c in ("digest", "root"))
        mine, theirs = (np.frombuffer(b"".join(t.column("minima").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for t in (probes, others))
        sets = lambda t, k: np.frombuffer(t.column("shingles")[k].as_py(), np.uint32)
        names, at = np.unique(np.concatenate([root, roots]), return_inverse=True)
        now = np.arange(len(names))  # the component that each one is part of by now
        one, two = at[: len(root)], at[len(root) :]
        for start in range(0, len(digest), 256):
            some = slice(start, start + 256)
            agree = np.zeros((len(digest[some]), len(digests)), np.uint8)
            for c in range(BANDS * ROWS):
                agree += mine[some, c][:, None] == theirs[:, c]
            i, j = np.nonzero((agree >= CLOSE) & (now[one[some]][:, None] != now[two]))
            for k in np.argsort(-agree[i, j].astype(np.int16), kind="stable"):
                a, b = start + i[k], j[k]
                if now[one[a]] != now[two[b]] and _are_alike(sets(probes, a), sets(others, b)):
                    now[now == now[two[b]]] = now[one[a]]
                    found.append((int(digest[a]), int(digests[b])))
    return pa.table({"one": pa.array([min(f) for f in found], pa.int64()), "two": pa.array([max(f) for f in found], pa.int64())})


def _across(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (one, two) among texts of one key that are in different components, enough to join those that
    belong together; ``placed``: key, digest and root of each text of a key that holds several components;
    ``texts``: digest, minima and shingles."""
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most"))
    parts = lambda n: F.ceil(n / F.lit(float(BLOCK))).cast("int")
    main = main.select("key", "main", parts(F.col("total")).alias("blocks"), parts(F.col("total") - F.col("most")).alias("chunks"))
    # a hot key's rows are many, its row of ``main`` is one: a skewed join, which AQE splits
    rows = placed.join(main, "key").join(texts, "digest")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("digest", F.lit(n)), F.col(n)).cast("int")
    held = ["digest", "root", "minima", "shingles"]
    probes = rows.where("root != main").select("key", dealt("chunks").alias("chunk"), spread("blocks").alias("block"), *held)
    others = rows.select("key", dealt("blocks").alias("block"), spread("chunks").alias("chunk"), *held)
    at = ["key", "block", "chunk"]
    probes = probes.select(*(F.col(c).alias(c) for c in [*at, *held]))  # columns of its own, apart from those of ``others``
    return probes.groupBy(*at).cogroup(others.groupBy(*at)).applyInArrow(_between, "one long, two long")


def _by_prints(marks: DataFrame) -> DataFrame:
    """Candidates (one, two) whose fingerprints are within 2 bits: texts of one fingerprint are tried
    with the first of them, and the first ones of linked fingerprints with each other."""
    texts = marks.where("size > 0").select("digest", "fingerprint").distinct()
    firsts = written(texts.groupBy("fingerprint").agg(F.min("digest").alias("head")))
    same = texts.join(firsts, "fingerprint").where("digest != head").select("digest", "head")
    links = linked(firsts)
    heads = links.join(firsts.select(F.col("fingerprint").alias("one"), F.col("head").alias("a")), "one").join(firsts.select(F.col("fingerprint").alias("two"), F.col("head").alias("b")), "two").select("a", "b")
    return same.unionByName(heads.toDF("digest", "head")).select(F.least("digest", "head").alias("one"), F.greatest("digest", "head").alias("two"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable by links) of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = written(docs.mapInArrow(_marks, MARKS))
    firsts = marks.groupBy("digest").agg(F.min("doc_id").alias("first"))
    keys = written(marks.select("digest", "size", F.explode("keys").alias("key")).distinct())
    drawn = F.min_by(F.struct("digest", "size"), F.xxhash64("digest", "key"))
    buckets = written(keys.groupBy("key").agg(F.count("*").alias("count"), drawn.alias("hub")).where("count > 1"))

    # made from the texts where they are asked for: as a table they would be as large as the texts
    sets = docs.select("text").mapInArrow(_sets, SETS).groupBy("digest").agg(F.first("shingles").alias("shingles"))

    def tried(pairs: DataFrame) -> DataFrame:
        # the sets are shuffled once, for both joins
        pairs = written(pairs.distinct())
        both = pairs.join(sets, F.col("one") == F.col("digest")).select("one", "two", F.col("shingles").alias("a"))
        both = both.join(sets, F.col("two") == F.col("digest")).select("one", "two", "a", F.col("shingles").alias("b"))
        return written(both.mapInArrow(_alike, "one long, two long"))

    def near(a: str, b: str):
        return F.least(a, b) >= F.lit(LEAST) * F.greatest(a, b) - F.lit(1e-9)

    few = keys.join(buckets.where(F.col("count") <= CROWD).select("key"), "key")
    others = few.select("key", F.col("digest").alias("two"), F.col("size").alias("size_two"))
    pairs = few.withColumnRenamed("digest", "one").join(others, "key").where((F.col("one") < F.col("two")) & near("size", "size_two")).select("one", "two")
    crowded = keys.join(buckets.where(F.col("count") > CROWD).select("key", "hub"), "key")
    starred = crowded.where((F.col("digest") != F.col("hub.digest")) & near("size", "hub.size")).select(F.least("digest", "hub.digest").alias("one"), F.greatest("digest", "hub.digest").alias("two"))
    links = tried(pairs.unionByName(starred).unionByName(_by_prints(marks)))
    tree = written(components(links))
    placed = crowded.join(tree, crowded["digest"] == tree["node"], "left").select("key", "digest", F.coalesce("root", "digest").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    split = written(placed.join(split, "key", "left_semi"))
    if not split.isEmpty():
        asked = written(split.select("digest").distinct())
        minima = marks.join(asked, "digest", "left_semi").groupBy("digest").agg(F.first("minima").alias("minima"))
        shingled = docs.select("text").mapInArrow(_sets, SETS).join(asked, "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("shingles"))
        links = written(links.unionByName(_across(split, written(minima.join(shingled, "digest")))))
        tree = written(components(links))
    named = firsts.join(tree, firsts["digest"] == tree["node"], "left").select("digest", "first", F.coalesce("root", "digest").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marks.select("doc_id", "digest").join(named.join(least, "root").select("digest", "component_id"), "digest").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies (see ``first_rows``)."""
    return first_rows(docs, near_copies)
