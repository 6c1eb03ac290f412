"""A prefix trie of conversations from mergeable partial tries.

A node is a distinct sequence of first turns; its key is its depth and 128 bits of hash of the roles
and texts along it, so no turn is compared with another and a turn's text travels once, when turns are
put in order. Every input partition combines its own rows into a partial trie: a table of its nodes
with members counted, the smallest member, and the ids of conversations that end there. Partial tries
are then merged by node key, ``FAN`` of them at a time and round after round, until one is left.
End lists are kept in pieces of at most ``2 ** PIECE`` ids in numerical order, so a node where a third
of all conversations end is many rows, never one long list; its hash is streamed over the pieces.

The rollup goes bottom-up: a node belongs to its smallest member, so every conversation owns the lower
part of its path. What it owns is summed upwards from its end (``ranges.along``, so a path of any
length is dealt over tasks), and the total is handed to the nodes above, which other conversations own;
these parts meet by node key again. Work is linear in the turns, with no round for each depth.

Edge cases: turns order by ``turn`` (null first), ties by role, then text; a null role or text is empty;
rows without a conv_id belong to no conversation. Repeated rows are turns of their own. A remainder has
the sign of conv_id, as in SQL. An empty table has no root and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.common import CRC32_SQL, crc32_sql, written
from quoteloom.llm.ranges import along

FAN = 16
PIECE = 10
BUFFER = 1 << 18
BLOCK = 100
HEADS = 6

NODE = ["depth", "x", "y"]
PARTIAL = "part long, piece long, depth long, x long, y long, px long, py long, chars long, first long, n long, ends array<long>"
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (a turn's number, from 1), chars, and two hashes (a, b) of its role and text."""
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    hashed = lambda k: F.xxhash64(F.lit(k), "role", "text")
    rows = rows.select("*", hashed(1).alias("a"), hashed(2).alias("b"), F.length("text").cast("long").alias("chars"))
    return along(rows, "conv_id", [F.asc_nulls_first("turn"), "role", "text"], ["a", "b", "chars"])


def rebuilt(said: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id) and their turns (conv_id, depth, a, b, chars) once every conversation
    c begins with the first h turns of conversation c - c % ``block``; h = crc32(c) % ``heads``.

    ``said``: conv_id, at, a, b, chars. A conversation's turns after its first h follow.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    lengths = written(said.groupBy("conv_id").agg(F.max("at").alias("turns")))
    plan = lengths.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    plan = plan.join(lengths.select(F.col("conv_id").alias("base"), F.col("turns").alias("given")), "base", "left")
    plan = written(plan.select("conv_id", "base", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("cut")))
    given = said.where(F.col("at") < heads).select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "a", "b", "chars")
    given = plan.where("cut > 0").join(given, "base").where("depth <= cut")
    shifts = plan.where("cut < h").select("conv_id", (F.col("h") - F.col("cut")).alias("shift"))
    own = said.select("*", h).where("at > h").join(shifts, "conv_id", "left")
    own = own.withColumn("depth", F.col("at") - F.coalesce("shift", F.lit(0)))
    columns = ["conv_id", "depth", "a", "b", "chars"]
    return lengths.select("conv_id"), given.select(*columns).unionByName(own.select(*columns))


def members(conversations: DataFrame, said: DataFrame) -> DataFrame:
    """A row for each conversation at each node of its path: conv_id, the node, the node above (px, py;
    null at the root) and the code points of its last text."""
    key = lambda k, *c: F.xxhash64(F.lit(k), "depth", *c)
    rows = said.select("conv_id", "depth", "chars", key(1, "a", "b").alias("x"), key(2, "b", "a").alias("y"))
    rows = rows.select("*", F.col("x").alias("own_x"), F.col("y").alias("own_y"))
    rows = along(rows, "conv_id", ["depth"], ["depth", "chars", "own_x", "own_y"], xors=["x", "y"])
    rows = rows.select("conv_id", *NODE, F.expr("x ^ own_x").alias("px"), F.expr("y ^ own_y").alias("py"), "chars")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    return rows.unionByName(conversations.select("conv_id", *(zero.alias(n) for n in NODE), none.alias("px"), none.alias("py"), zero.alias("chars")))


def _combined(rows: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(rows).group_by(["piece", *NODE]).aggregate([("px", "max"), ("py", "max"), ("chars", "max"), ("first", "min"), ("n", "sum")])
    return found.rename_columns([c.rpartition("_")[0] or c for c in found.column_names])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial trie of a partition; over ``BUFFER`` nodes it goes out in several parts."""
    part = TaskContext.get().partitionId()
    order = [c.split()[0] for c in PARTIAL.split(", ")]
    none = pa.scalar(None, pa.int64())

    def out(rows: pa.Table, lists: pa.Array) -> Iterator[pa.RecordBatch]:
        rows = rows.append_column("part", pa.repeat(pa.scalar(part, pa.int64()), len(rows))).append_column("ends", lists)
        yield from rows.select(order).to_batches(4096)

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from out(rows, pa.array([[]] * len(rows), pa.list_(pa.int64())))

    def listed(rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        found = pa.concat_tables(rows).group_by(["piece", *NODE]).aggregate([("first", "list"), ("first", "min")]).rename_columns(["piece", *NODE, "ends", "first"])
        lists, found = found.column("ends"), found.drop_columns("ends")
        for name, value in (("px", none), ("py", none), ("chars", pa.scalar(0, pa.int64())), ("n", pa.scalar(0, pa.int64()))):
            found = found.append_column(name, pa.repeat(value, len(found)))
        yield from out(found, lists)

    rows, ends, n_rows, n_ends = [], [], 0, 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        here = table.filter(pa.compute.equal(table.column("n"), 1)).select(["piece", *NODE, "px", "py", "chars", "first", "n"])
        gone = table.filter(pa.compute.equal(table.column("n"), 0)).select(["piece", *NODE, "first"])
        rows, ends, n_rows, n_ends = [*rows, here], [*ends, gone], n_rows + len(here), n_ends + len(gone)
        if n_rows > BUFFER:
            rows = [_combined(rows)]
            n_rows = len(rows[0])
            if n_rows > BUFFER // 2:
                yield from counted(rows[0])
                rows, n_rows = [], 0
        if n_ends > BUFFER:
            yield from listed(ends)
            ends, n_ends = [], 0
    if n_rows:
        yield from counted(_combined(rows))
    if n_ends:
        yield from listed(ends)


def partial_tries(paths: DataFrame) -> DataFrame:
    """A node table of each partition of ``paths`` (see ``members``)."""
    piece = F.shiftright("conv_id", PIECE).alias("piece")
    here = paths.select(piece, *NODE, "px", "py", "chars", F.col("conv_id").alias("first"), F.lit(1).cast("long").alias("n"))
    last = paths.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("last"))
    none = F.lit(None).cast("long")
    gone = last.select(piece, *(F.col(f"last.{n}").alias(n) for n in NODE), none.alias("px"), none.alias("py"), none.alias("chars"), F.col("conv_id").alias("first"), F.lit(0).cast("long").alias("n"))
    return here.unionByName(gone).mapInArrow(_partial, PARTIAL)


def merged(tries: DataFrame, fan: int = FAN) -> DataFrame:
    """One trie of the partial ``tries``: ``fan`` of them become one in each round."""
    parts = (tries.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        tries = tries.withColumn("part", F.floor(F.col("part") / fan)).groupBy("part", "piece", *NODE)
        highest = [F.max(c).alias(c) for c in ("px", "py", "chars")]
        tries = tries.agg(*highest, F.min("first").alias("first"), F.sum("n").alias("n"), F.flatten(F.collect_list("ends")).alias("ends"))
        parts = -(-parts // fan)
        if parts <= 1:
            return tries


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's end lists, from its pieces in order."""
    node, sha, out = None, None, []

    def done() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], (*n, h), strict=True)) for n, h in out])
            out.clear()

    for batch in batches:
        for *here, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
            if here == node:
                sha.update(b",")
            else:
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = here, hashlib.sha256()
            sha.update(ids.encode())
        yield from done()
    if node is not None:
        out.append((node, sha.hexdigest()))
    yield from done()


def end_hashes(trie: DataFrame) -> DataFrame:
    """The node and the SHA-256 of the comma-joined ids that end there, in numerical order."""
    ids = F.array_join(F.transform(F.array_sort("ends"), lambda i: i.cast("string")), ",")
    pieces = trie.where(F.size("ends") > 0).select(*NODE, "piece", ids.alias("ids"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInArrow(_hashed, "depth long, x long, y long, ends_sha256 string")


def rolled_up(paths: DataFrame, trie: DataFrame) -> DataFrame:
    """A row for each node, with what its subtree holds; ``trie``: the merged one."""
    nodes = trie.groupBy(*NODE).agg(*(F.max(c).alias(c) for c in ("px", "py", "chars")), F.min("first").alias("first"), F.sum("n").alias("n"))
    nodes = written(nodes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("saved", (F.col("n") - 1) * F.col("chars")).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    owned = along(nodes, "first", [F.desc("depth")], [*NODE, "px", "py", "n", "n_children"], sums=["saved", "leaves"])
    totals = owned.groupBy(F.col("first").alias("conv_id")).agg(F.max("saved").alias("saved"), F.max("leaves").alias("leaves"), F.min("depth").alias("top"))
    totals = totals.where("top > 0 and (saved > 0 or leaves > 0)")
    handed = paths.select("conv_id", *NODE).join(totals, "conv_id").where("depth < top").groupBy(*NODE)
    handed = handed.agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    above = owned.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("first").alias("parent_conv_id"))
    found = owned.join(handed, NODE, "left").join(above, ["depth", "px", "py"], "left").join(end_hashes(trie), NODE, "left")
    more = lambda n: (F.col(n) + F.coalesce(f"more_{n}", F.lit(0)))
    return found.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", more("leaves").alias("n_leaves"), more("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame, block: int | None = None, heads: int = HEADS, fan: int = FAN) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text), branched anew by
    ``rebuilt`` where ``block`` is given: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    said = turns(conversations)
    if block:
        known, said = rebuilt(said, block, heads)
    else:
        known, said = said.select("conv_id").distinct(), said.withColumnRenamed("at", "depth")
    paths = members(known, said)
    trie = written(merged(written(partial_tries(paths)), fan))
    return rolled_up(paths, trie)




SQL = f"""
WITH {CRC32_SQL}, turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), named AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM turns
), plan AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("name")} % 6 AS h FROM named, crc
), joined AS (
  SELECT plan.conv_id, place, role, text FROM plan JOIN turns ON turns.conv_id = base WHERE place <= h
  UNION ALL SELECT plan.conv_id, place, role, text FROM plan JOIN turns USING (conv_id) WHERE place > h
), numbered AS (
  SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, sha256(sha256(role) || sha256(text)) AS mark FROM joined
), paths AS (
  SELECT conv_id, depth, length(text) AS chars, list(mark) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM numbered
  UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM plan
), lengths AS (
  SELECT conv_id, max(depth) AS last FROM paths GROUP BY conv_id
), nodes AS (
  SELECT path, depth, min(conv_id) AS first, count(*) AS n, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth
), parents AS (
  SELECT child.path, parent.path AS above, parent.first FROM nodes child JOIN nodes parent ON parent.depth = child.depth - 1 AND parent.path = child.path[:-2]
), children AS (
  SELECT above AS path, count(*) AS n_children FROM parents GROUP BY above
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)
), handed AS (
  SELECT path, unnest(range(0, depth + 1)) AS above, n_children, (n - 1) * chars AS saved FROM counted
), subtrees AS (
  SELECT path[:above] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved FROM handed GROUP BY ALL
)
SELECT CAST(counted.first AS BIGINT) AS conv_id, CAST(depth AS BIGINT) AS depth, parents.first AS parent_conv_id, CAST(n AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM counted JOIN subtrees USING (path) LEFT JOIN parents USING (path)
"""
