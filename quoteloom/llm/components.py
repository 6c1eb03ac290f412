"""Connected components by alternating large-star and small-star steps.

Each step is a grouping and a join over the links, so no task holds a component. Every round's
links are written to the shared folder; rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.common import written

ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.hash("child", "root").cast("long")), F.bit_xor(F.xxhash64("child", "root"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (one, two); the root is the smallest node.

    Links of a node to itself and null ends are ignored; no links give no rows.
    """
    one, two = F.col("one"), F.col("two")
    now = written(links.where(one != two).select(F.greatest(one, two).alias("child"), F.least(one, two).alias("root")).distinct())
    state = _state(now)
    if not state[0]:
        return now.select(F.col("child").alias("node"), "root")
    for _ in range(ROUNDS):
        ends = now.select(F.col("child").alias("node"), F.col("root").alias("other")).unionByName(now.select(F.col("root").alias("node"), F.col("child").alias("other")))
        least = ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = ends.where(F.col("other") > F.col("node")).join(least, "node").select(F.col("other").alias("child"), F.col("least").alias("root")).distinct()
        least = large.groupBy("child").agg(F.min("root").alias("least"))
        small = large.join(least, "child").where(F.col("root") != F.col("least")).select(F.col("root").alias("child"), F.col("least").alias("root"))
        now = written(small.unionByName(least.select("child", F.col("least").alias("root"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    nodes = now.select(F.col("child").alias("node"), "root")
    return nodes.unionByName(now.select(F.col("root").alias("node"), "root").distinct())
