"""Mixing sources to target weights by weighted fair queueing.

A source's target is its share, by weight, of ``share`` times all words; it stops at ``repeats``
times the source's own words, and what is over goes to the other sources by weight until no
target is above its stop. Every source then shuffles its documents (by a hash of doc_id) and
serves them ``repeats`` times in that order, in packets of words: a document is one packet, but a
packet ends after a thousandth of the source's target (``PACKETS``), or one word if that is more.
A packet's virtual finish time is its source's words up to its end, divided by the source's target.
All packets of all sources are range-sorted over the cluster by that time, summed in that order, and
truncated where the sum reaches the total budget; the packet there is cut. So every source is within
a few packets of its target, however long its documents are.

Cumulative sums within a source run in two steps, over 4096 hash slices and then within each, so a
source that holds a third of all rows is dealt over 4096 groups; those over all sources and over all
packets run over ranges (``common.running``). No task holds all rows of a source or of the mix.

Edge cases: a null or blank text has size 0 and nothing is taken of it. A null source is a source
of its own, the last. Every row is a document of its own: repeated rows, rows that share a doc_id
and rows without one (shuffled by their texts) are served one after the other. An empty table gives
an empty result. Of further columns, ``mix`` keeps those whose names are not its own results
(copy, taken, target, finish), of any type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quoteloom.llm.common import fresh, named, running, without, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
PACKETS = 1000
SLICES = 3  # hex digits
RESULTS = ("copy", "taken", "target", "finish")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """``sources`` (key, total) with the target of each; weights repeat in the order of keys."""
    one = F.lit(1).cast("long")
    sources = running(sources, ["key"], {"order": one})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("order") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("stop", F.col("total") * F.lit(float(repeats)))
    # the least stops for their weight are reached first, as all targets rise together
    sources = sources.withColumn("level", F.col("stop") / F.col("weight"))
    sources = written(running(sources, ["level", "key"], {"stopped": F.col("stop"), "risen": F.col("weight")}))
    words, weighed = sources.agg(F.sum("total"), F.sum("weight")).first()
    budget = F.lit(float(words or 0) * share)
    full = F.col("stop") * (F.lit(weighed) - F.col("risen")) <= (budget - F.col("stopped")) * F.col("weight")
    sources = written(sources.withColumn("full", full))
    given, rising = sources.agg(F.sum(F.when(F.col("full"), F.col("stop")).otherwise(0.0)), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight")))).first()
    return sources.select("key", "total", F.when(F.col("full"), F.col("stop")).otherwise((budget - F.lit(given)) * F.col("weight") / F.lit(rising)).alias("target"))


def _queued(slim: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """``slim`` (row, doc_id, text_mark, source, size) with source_size, target, served, and takes:
    the words that the mix takes of each copy."""
    if share > repeats or min(weights) <= 0:
        raise ValueError("share must not exceed repeats, and weights must be positive")
    # '1' and '2' put a null source last
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("2"))
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text_mark")))
    slim = written(slim.select("row", "doc_id", "text_mark", "source", key.alias("key"), F.substring(mark, 1, SLICES).alias("slice"), F.substring(mark, SLICES + 1, 13).alias("mark"), "size"))
    slices = written(slim.groupBy("key", "slice").agg(F.sum("size").alias("words")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    aims = targets(slices.groupBy("key").agg(F.sum("words").alias("total")), weights, share, repeats)
    begun = slices.select("key", "slice", before.alias("before")).join(aims, "key")
    inner = Window.partitionBy("key", "slice").orderBy("mark", "doc_id", "size", "text_mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.join(begun, ["key", "slice"]).withColumn("served", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = written(placed.select("row", "doc_id", "source", "key", "size", F.col("total").alias("source_size"), "target", "served"))

    packet = F.greatest(F.lit(1).cast("long"), F.floor(F.col("target") / PACKETS).cast("long"))
    copies = placed.where("size > 0").withColumn("copy", F.explode(F.array(*(F.lit(k) for k in range(repeats))))).withColumn("most", packet)
    packets = copies.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("most"))))
    words = F.least(F.col("size") - F.col("start"), F.col("most"))
    place = F.col("source_size") * F.col("copy") + F.col("served") + F.col("start")
    packets = packets.select("key", "served", "size", "copy", place.alias("place"), words.alias("words"), ((place + words) / F.col("target")).alias("finish"))
    queue = running(packets, ["finish", "key", "place"], {"ahead": F.col("words")})
    budget = math.floor((slices.agg(F.sum("words")).first()[0] or 0) * share)
    cut = queue.withColumn("taken", F.least(F.col("words"), F.lit(budget).cast("long") - F.col("ahead"))).where("taken > 0")
    takes = cut.groupBy(F.col("key").alias("of"), F.col("served").alias("at"), F.col("size").alias("long")).agg(
        F.array(*(F.sum(F.when(F.col("copy") == k, F.col("taken")).otherwise(0)) for k in range(repeats))).alias("takes")
    )
    # of the rows at one place of a source only one has words
    found = placed.join(takes, (F.col("key") == F.col("of")) & (F.col("served") == F.col("at")) & (F.col("size") == F.col("long")), "left")
    none = F.array(*(F.lit(0).cast("long") for _ in range(repeats)))
    return found.select("row", "doc_id", "source", "size", "source_size", "target", "served", F.coalesce("takes", none).alias("takes"))


def virtual_times(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, served (words of its
    source before it), taken (words of it in the mix, over all copies)."""
    slim = docs.select(F.lit(0).cast("long").alias("row"), "doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_mark"), "source", word_count(F.col("text")).alias("size"))
    found = _queued(slim, weights, share, repeats)
    return found.select("doc_id", "source", "size", "source_size", "target", "served", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The mix in order of virtual finish time: the columns of ``docs``, copy (from 0), taken (words
    of that copy), target (of its source) and finish. A copy that the end of the mix cuts has only
    its first ``taken`` words, as n_chars then tells."""
    docs = without(docs, *RESULTS)
    own = fresh(docs)
    # rows are numbered once, in a table, so that texts find their copies again
    numbered = written(docs.withColumn(f"{own}row", F.monotonically_increasing_id()))
    slim = numbered.select(F.col(f"{own}row").alias("row"), "doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_mark"), "source", word_count(F.col("text")).alias("size"))
    copies = _queued(slim, weights, share, repeats).select("row", "size", "source_size", "target", "served", F.posexplode("takes").alias("copy", "taken")).where("taken > 0")
    finish = (F.col("source_size") * F.col("copy") + F.col("served") + F.col("size")) / F.col("target")
    copies = copies.select(*(c.alias(f"{own}{n}") for n, c in {"of": F.col("row"), "size": F.col("size"), "copy": F.col("copy"), "taken": F.col("taken"), "target": F.col("target"), "finish": finish}.items()))
    rows = numbered.join(copies, F.col(f"{own}row") == F.col(f"{own}of"))
    pieces = F.slice(F.regexp_extract_all("text", F.lit("([\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+)"), F.lit(1)), F.lit(1), F.col(f"{own}taken").cast("int"))
    rows = rows.withColumn("text", F.when(F.col(f"{own}taken") < F.col(f"{own}size"), F.array_join(pieces, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    results = [F.col(f"{own}{n}").alias(n) for n in RESULTS]
    return rows.select(*(named(c) for c in docs.columns), *results, F.col(f"{own}row")).orderBy("finish", "doc_id", "copy", f"{own}row").drop(f"{own}row")


SQL = """
WITH sized AS (
  SELECT doc_id, coalesce('1' || source, '2') AS key, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS mark, md5(coalesce(text, '')) AS text_mark,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS total FROM sized GROUP BY key
), weighed AS (
  SELECT key, total, CAST([5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
         total * CAST(2 AS DOUBLE) AS stop, CAST(sum(total) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS budget
  FROM sources
), filled AS (
  SELECT *, stop * sum(weight) OVER (ORDER BY stop / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (budget - coalesce(sum(stop) OVER (ORDER BY stop / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full
  FROM weighed
), aims AS (
  SELECT key, total, CAST(floor(budget) AS BIGINT) AS budget, CASE WHEN is_full THEN stop ELSE
    (budget - sum(CASE WHEN is_full THEN stop ELSE 0 END) OVER ()) * weight / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target
  FROM filled
), served AS (
  SELECT row_number() OVER () AS row, doc_id, key, size, total, target, budget, greatest(1, CAST(floor(target / 1000) AS BIGINT)) AS most,
         CAST(coalesce(sum(size) OVER (PARTITION BY key ORDER BY mark, doc_id NULLS FIRST, size, text_mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized JOIN aims USING (key)
), packet AS (
  SELECT row, key, budget, target, total * copy + before + start AS place, least(size - start, most) AS words
  FROM served, (VALUES (0), (1)) AS c(copy), unnest(generate_series(CAST(0 AS BIGINT), size - 1, most)) AS s(start)
  WHERE size > 0
), queued AS (
  SELECT row, words, budget, coalesce(sum(words) OVER (ORDER BY CAST(place + words AS DOUBLE) / target, key, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM packet
), cut AS (
  SELECT row, CAST(sum(least(words, budget - ahead)) AS BIGINT) AS taken FROM queued WHERE ahead < budget GROUP BY row
)
SELECT doc_id, size, total AS source_size, target, coalesce(taken, 0) AS taken
FROM served LEFT JOIN cut USING (row)
"""
