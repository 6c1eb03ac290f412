"""Nearest neighbours by inner product: probed lists scanned with an adaptive number of dimensions.

Largest inner product is turned into smallest distance by one more dimension (the root of the
largest squared norm less the own one). Vectors are rotated by a random orthogonal matrix and laid
out in column blocks. Within a probed list the distances of all its queries to all its candidates
grow block by block; after d of D dimensions a pair is abandoned if its partial distance times D/d
exceeds the query's threshold times (1 + EPSILON / sqrt(d)) squared, the hypothesis test of adaptive
sampling. Those never abandoned get their inner product in double precision from the original vectors.

Work is spread by cell. Centroids are fitted on ``sample`` vectors and every vector is put in its
nearest list; a cell is some lists near each other, or a shard of one large list, of about ``cell``
numbers. A query goes once to each cell that holds a list it probes, with the list numbers, and comes
back with TOP + 1 candidates a cell. It probes as many lists as hold ``AIM`` of the true neighbours of
CALIBRATE vectors, which one pass over the whole table finds by brute force. Its nearest list is
searched first; that gives the threshold for the rest. A cell's queries are dealt in chunks of about
``chunk``, so no group grows with the input.

Equal vectors are one candidate that carries its TOP + 1 smallest ids (no more can be in any
result), gathered in each task before the shuffle; equal queries are searched once. A query that
finds fewer than TOP candidates visits all lists.

Edge cases: vectors that are null, of another length than most, zero, or with a null or non-finite
component take no part. Repeated ids with one vector count once. Ties go to the smaller vec_id.
Float and double vectors are scored as they are given; other numbers as doubles. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from quoteloom.llm.common import written

TOP = 20
SAMPLE = 20_000
MOST_LISTS = 16_384
CELL = 1 << 19
CHUNK = 4096
BLOCK = 16
EPSILON = 2.1
LISTS = 1 / 3  # times the root of the number of vectors
AIM = 0.95
CALIBRATE = 200
ROUNDS = 8

FOUND = "query long, candidate long, score double"


def _usable(vectors: DataFrame) -> tuple[DataFrame, str]:
    kind = vectors.schema["embedding"].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(f"array<{number}>").alias("embedding"))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)), number


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column (equal lengths, no nulls) as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists_of(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)), pa.array(rows.ravel()))


def _merged(top: int):
    """One row for each distinct vector of a batch."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, vectors = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"))
            order = np.lexsort((ids, *vectors.T))
            ids, vectors = ids[order], vectors[order]
            new = np.flatnonzero(np.insert((vectors[1:] != vectors[:-1]).any(axis=1), 0, True))
            ends = np.append(new[1:], len(ids))
            few = [np.unique(ids[a:b])[: top + 1] for a, b in zip(new, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([lists_of(vectors[new]), pa.array(few, pa.list_(pa.int64()))], ["embedding", "ids"])

    return merge


class Space:
    """The added dimension, the rotation and the lists. Vectors are scaled by ``scale`` first."""

    def __init__(self, sample: np.ndarray, count: int, scale: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scale, self.size = scale, sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.normal(size=(self.size, self.size)))[0].astype(np.float32)
        points = self.turned(sample, True)
        lists = max(1, min(MOST_LISTS, len(points), round(LISTS * math.sqrt(count))))
        self.centroids = points[rng.choice(len(points), lists, replace=False)]
        for _ in range(ROUNDS):
            own = self.nearest(points, 1)[:, 0]
            sums, counts = np.zeros_like(self.centroids), np.bincount(own, minlength=lists)
            np.add.at(sums, own, points)
            self.centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], self.centroids).astype(np.float32)
        # lists near each other get numbers near each other: by the nearest of some centroids
        coarse = self.centroids[rng.choice(lists, max(1, math.isqrt(lists)), replace=False)]
        far = (coarse**2).sum(axis=1) - 2 * self.centroids @ coarse.T
        self.centroids = self.centroids[np.argsort(far.argmin(axis=1), kind="stable")]
        self.probes = lists
        self.cells, self.shards = np.zeros(lists, np.int64), np.ones(lists, np.int64)

    def deal(self, sizes: np.ndarray, most: int) -> None:
        """Cells of about ``most`` vectors: some lists each, or shards of one."""
        cell = held = 0
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                cell, held = cell + 1, 0
            self.cells[k], self.shards[k] = cell, max(1, -(-size // most))
            held += size
            if size > most:
                cell, held = cell + int(self.shards[k]), 0

    def turned(self, vectors: np.ndarray, stored: bool) -> np.ndarray:
        """Rotated with the added dimension, which is 0 for a query; no stored one is longer than 1."""
        vectors = vectors.astype(np.float64) / self.scale
        left = 1 - (vectors**2).sum(axis=1) if stored else np.zeros(len(vectors))
        return np.concatenate([vectors, np.sqrt(np.maximum(left, 0))[:, None]], axis=1).astype(np.float32) @ self.rotation

    def nearest(self, points: np.ndarray, count: int) -> np.ndarray:
        out = []
        for at in range(0, len(points), 2048):
            far = (self.centroids**2).sum(axis=1) - 2 * points[at : at + 2048] @ self.centroids.T
            near = np.argpartition(far, count - 1, axis=1)[:, :count] if count < far.shape[1] else np.broadcast_to(np.arange(far.shape[1]), far.shape)
            out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out) if out else np.zeros((0, count), int)


def scan_list(queries: np.ndarray, candidates: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that pass every test. ``limits``: the squared distance beyond which
    a query wants none."""
    size = queries.shape[1]
    factor = lambda seen: (1 + EPSILON / math.sqrt(seen)) ** 2 * seen / size

    def gaps(a: int, b: int) -> np.ndarray:
        q, c = queries[:, a:b], candidates[:, a:b]
        return (q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * q @ c.T

    seen = min(BLOCK, size)
    far = gaps(0, seen)
    while True:
        within = limits * (factor(seen) if seen < size else 1.0001) + 1e-5
        i, j = np.nonzero(far <= within[:, None])
        if seen == size or 4 * len(i) < far.size:
            break
        ahead = min(seen + BLOCK, size)
        far += gaps(seen, ahead)  # most pairs live on: all at once
        seen = ahead
    far = far[i, j]
    while seen < size:
        ahead = min(seen + BLOCK, size)
        gap = candidates[j, seen:ahead] - queries[i, seen:ahead]
        far = far + np.einsum("ij,ij->i", gap, gap)
        seen = ahead
        keep = far <= limits[i] * (factor(seen) if seen < size else 1.0001) + 1e-5
        i, j, far = i[keep], j[keep], far[keep]
    return i, j


def best_of(query: np.ndarray, name: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest scores of each query, ties by name."""
    order = np.lexsort((name, -score, query))
    query = query[order]
    first = np.flatnonzero(np.insert(query[1:] != query[:-1], 0, True)) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return order[rank < top]


def _search(shared, top: int):
    """The best of a cell for each of a chunk of queries."""

    def search(key, probes: pa.Table, stored: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        if len(probes) and len(stored):
            space = shared.value
            number = stored.column("list").to_numpy()
            order = np.argsort(number, kind="stable")
            number, ids = number[order], stored.column("candidate").to_numpy()[order]
            plain, asked = matrix(stored.column("embedding"))[order].astype(np.float64), matrix(probes.column("vector")).astype(np.float64)
            turned, wanted = space.turned(plain, True), space.turned(asked, False)
            # the inner product to beat as a squared distance
            least = probes.column("least").to_numpy()
            limits = (wanted.astype(np.float64) ** 2).sum(axis=1) + 1 - 2 * least / space.scale**2
            visits = probes.column("lists").combine_chunks()
            row = np.repeat(np.arange(len(probes)), np.diff(visits.offsets.to_numpy()))
            visit = visits.flatten().to_numpy()
            for k in np.unique(visit):
                a, b = np.searchsorted(number, [k, k + 1])
                mine = row[visit == k]
                for at in range(0, len(mine) if a < b else 0, 256):
                    some = mine[at : at + 256]
                    for to in range(a, b, 8192):
                        part = slice(to, min(b, to + 8192))
                        if np.isfinite(limits[some]).all():
                            i, j = scan_list(wanted[some], turned[part], limits[some])
                        else:
                            i, j = _all_near(asked[some], plain[part], top)
                        if len(i):
                            score = np.einsum("ij,ij->i", asked[some[i]], plain[part][j])
                            few = best_of(i, ids[part][j], score, top + 1)
                            found.append([some[i[few]], ids[part][j[few]], score[few]])
            query, name, score = map(np.concatenate, zip(*found, strict=True))
            few = best_of(query, name, score, top + 1)
            found = [[probes.column("query").to_numpy()[query[few]], name[few], score[few]]]
        return pa.table(dict(zip(("query", "candidate", "score"), found[0], strict=True)))

    return search


def _all_near(asked: np.ndarray, plain: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that can be among the ``top`` + 1 best of each query, when nothing is known of it yet."""
    score = asked @ plain.T
    if score.shape[1] > top + 1:
        last = -np.partition(-score, top, axis=1)[:, top]
        return np.nonzero(score >= last[:, None] - 1e-9 * np.abs(last[:, None]))
    return np.nonzero(np.ones(score.shape, bool))


def _probes_for(stored: DataFrame, space: Space, asked: np.ndarray, top: int) -> int:
    """How many lists hold AIM of the true neighbours of ``asked`` in all of ``stored``."""
    shared = stored.sparkSession.sparkContext.broadcast((space, asked))  # CALIBRATE vectors

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, asked = shared.value
        for batch in batches:
            if len(batch):
                plain = matrix(batch.column("embedding")).astype(np.float64)
                i, j = _all_near(asked.astype(np.float64), plain, top)
                score = np.einsum("ij,ij->i", asked[i].astype(np.float64), plain[j])
                few = best_of(i, batch.column("candidate").to_numpy()[j], score, top + 1)
                yield pa.RecordBatch.from_arrays([pa.array(i[few]), pa.array(score[few]), pa.array(batch.column("list").to_numpy()[j[few]])], ["query", "score", "list"])

    near = stored.mapInArrow(brute, "query long, score double, list int")
    # the vector itself comes first
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "list"))
    near = near.withColumn("place", place).where(F.col("place").between(2, top + 1)).select("query", "list").toArrow()  # CALIBRATE x TOP rows
    if not len(near):
        return len(space.centroids)
    rank = np.argsort(space.nearest(space.turned(asked, False), len(space.centroids)), axis=1)
    return min(len(space.centroids), 1 + int(np.quantile(rank[near.column("query").to_numpy(), near.column("list").to_numpy()], AIM, method="higher")))


def nearest(vectors: DataFrame, is_query, top: int = TOP, sample: int = SAMPLE, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` nearest other rows of each row for
    which the Column ``is_query`` (of vec_id) holds."""
    spark = vectors.sparkSession
    usable, number = _usable(vectors)
    sizes = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    usable = usable.where(F.size("embedding") == sizes[0]["n"])
    few = usable.mapInArrow(_merged(top), f"embedding array<{number}>, ids array<long>")
    few = few.groupBy(F.xxhash64("embedding").alias("mark"), "embedding").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top + 1).alias("ids"))
    distinct = written(few.select("mark", F.element_at("ids", 1).alias("candidate"), "ids", "embedding"))
    # the longest vector, by components scaled so that no square overflows
    most = distinct.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()[0]
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x.cast("double") / F.lit(most)) * (x.cast("double") / F.lit(most)))
    count, longest = distinct.agg(F.count("*"), F.max(norm)).first()
    drawn = matrix(distinct.orderBy("mark", "candidate").limit(sample + CALIBRATE).select("embedding").toArrow().column("embedding"))
    held = min(CALIBRATE, max(1, len(drawn) // 2))
    # the rows that say how much to probe are not those that the lists are fitted on
    space = Space(drawn[held:] if len(drawn) > held else drawn, count, most * math.sqrt(longest) * (1 + 1e-12))
    fitted = spark.sparkContext.broadcast(space)  # MOST_LISTS centroids at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                points = fitted.value.turned(matrix(batch.column("embedding")), True)
                yield pa.RecordBatch.from_arrays([batch.column("candidate"), batch.column("embedding"), pa.array(fitted.value.nearest(points, 1)[:, 0].astype(np.int32))], ["candidate", "embedding", "list"])

    stored = written(distinct.mapInArrow(assign, f"candidate long, embedding array<{number}>, list int"))
    counts = stored.groupBy("list").count().toArrow()  # a row for each list
    lists = np.zeros(len(space.centroids), np.int64)
    lists[counts.column("list").to_numpy()] = counts.column("count").to_numpy()
    space.deal(lists, max(1, cell // sizes[0]["n"]))
    space.probes = _probes_for(stored, space, drawn[:held], top)
    shared = spark.sparkContext.broadcast(space)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("list").to_numpy()
            shard = batch.column("candidate").to_numpy() % shared.value.shards[number]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.cells[number] + shard)], [*batch.schema.names, "cell"])

    def visit(first: int, last: int | None):
        """A row for each cell that holds some of a query's ``first`` to ``last`` nearest lists."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space = shared.value
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    some = batch.slice(at, 1024)
                    end = last or len(space.centroids)
                    near = space.nearest(space.turned(matrix(some.column("vector")), False), end)[:, first:]
                    row, number = np.repeat(np.arange(len(some)), near.shape[1]), near.ravel()
                    shards = space.shards[number]
                    row, number, shard = np.repeat(row, shards), np.repeat(number, shards), np.arange(shards.sum()) - np.repeat(np.cumsum(shards) - shards, shards)
                    to = space.cells[number] + shard
                    order = np.lexsort((number, to, row))
                    row, number, to = row[order], number[order], to[order]
                    new = np.flatnonzero(np.insert((row[1:] != row[:-1]) | (to[1:] != to[:-1]), 0, True)) if len(row) else row
                    names = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(number.astype(np.int32)))
                    take = pa.array(row[new])
                    yield pa.RecordBatch.from_arrays([some.column("query").take(take), some.column("vector").take(take), some.column("least").take(take), pa.array(to[new]), names], ["query", "vector", "least", "cell", "lists"])

        return run

    placed = stored.mapInArrow(place, f"candidate long, embedding array<{number}>, list int, cell long")
    named = usable.where(is_query).select("vec_id", "embedding", F.xxhash64("embedding").alias("mark")).join(distinct.select("mark", "candidate", "embedding"), ["mark", "embedding"])
    named = written(named.select("vec_id", F.col("candidate").alias("query")))
    asked = written(distinct.join(named.select(F.col("query").alias("candidate")).distinct(), "candidate", "left_semi").select(F.col("candidate").alias("query"), F.col("embedding").alias("vector")))
    unknown = F.lit(float("-inf")).alias("least")

    def searched(queries: DataFrame, first: int, last: int | None) -> DataFrame:
        """``queries`` (query, vector, least) in their ``first`` to ``last`` nearest lists."""
        probes = written(queries.mapInArrow(visit(first, last), f"query long, vector array<{number}>, least double, cell long, lists array<int>"))
        chunks = probes.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))  # a row for each cell
        left = probes.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int"))
        times = chunks.select(F.col("cell").alias("of"), F.col("chunks").alias("times"))
        right = placed.join(F.broadcast(times), F.col("cell") == F.col("of")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
        keys = ["cell", "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(shared, top), FOUND)

    opened = written(searched(asked.select("query", "vector", unknown), 0, 1))
    by_score = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))
    # the last of top + 1 found so far bounds the rest
    limits = opened.withColumn("place", by_score).where(F.col("place") == top + 1).select("query", F.col("score").alias("least"))
    rest = asked.join(limits, "query", "left").select("query", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    found = written(opened.unionByName(searched(rest, 1, space.probes)) if space.probes > 1 else opened)
    if space.probes < len(space.centroids):
        enough = found.join(distinct.select("candidate", F.size("ids").alias("rows")), "candidate").groupBy("query").agg(F.sum("rows").alias("rows")).where(F.col("rows") > top)
        short = written(asked.join(enough, "query", "left_anti").select("query", "vector", unknown))
        if not short.isEmpty():
            found = found.join(short, "query", "left_anti").unionByName(searched(short, 0, None))
    found = found.withColumn("place", by_score).where(F.col("place") <= top + 1)
    rows = found.join(distinct.select("candidate", "ids"), "candidate").select("query", "score", F.explode("ids").alias("id"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    rows = rows.join(named.select(F.col("vec_id").alias("query_id"), "query").distinct(), "query").where(F.col("id") != F.col("query_id"))
    return rows.withColumn("rank", order).where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
