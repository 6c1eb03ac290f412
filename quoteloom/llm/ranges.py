"""Running values along the rows of a key, however many rows a key has.

The rows are range-sorted over the cluster by key and order, and each range is read once, in order,
carrying nothing but the last row. A key that goes on in the next range gets there what the ranges
before hold of it: a table of at most two keys a range, which is broadcast. So no task holds a key,
and a key with a third of all rows is dealt over as many ranges as it fills.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.llm.common import column, written


def _running(values: np.ndarray, start: np.ndarray, heads: int, carry: int, add, undo) -> np.ndarray:
    """``values`` accumulated from each row's ``start``; the first ``heads`` rows go on from ``carry``."""
    total = add.accumulate(values)
    before = np.concatenate([[0], total[:-1]])
    out = undo(total, before[start])
    out[:heads] = add(out[:heads], carry)
    return out


def _scan(key: str, keep: list[str], sums: list[str], xors: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        carry = dict.fromkeys(["at", *sums, *xors], 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = column(batch, key)
            new = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            heads = int(np.argmax(new)) if new.any() else len(keys)
            found = {"at": _running(np.ones(len(keys), np.int64), start, heads, carry["at"], np.add, np.subtract)}
            found |= {n: _running(column(batch, n), start, heads, carry[n], np.add, np.subtract) for n in sums}
            found |= {n: _running(column(batch, n), start, heads, carry[n], np.bitwise_xor, np.bitwise_xor) for n in xors}
            last, carry = keys[-1], {n: v[-1] for n, v in found.items()}
            arrays = [batch.column(key), *(batch.column(n) for n in keep), *map(pa.array, found.values()), pa.array(np.full(len(keys), part, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [key, *keep, *found, "_range"])

    return run


def along(rows: DataFrame, key: str, order: list[str | Column], keep: list[str], sums: list[str] = (), xors: list[str] = ()) -> DataFrame:
    """``key``, ``keep``, ``at`` (a row's number along its key, from 1), and of the columns ``sums`` and
    ``xors`` the sum and the exclusive or over the key's rows up to and with each row.

    ``key`` and the accumulated columns are longs without nulls. Rows that tie in ``order`` must be alike
    in all other columns.
    """
    sums, xors = list(sums), list(xors)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{key} long", *(f"{n} {kinds[n]}" for n in keep), "at long", *(f"{n} long" for n in sums + xors), "_range int"])
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(key, *keep, *sums, *xors)
    local = written(ranged.mapInArrow(_scan(key, keep, sums, xors), schema))
    ends = local.groupBy("_range").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    spans = ends.select(F.explode(F.array("low", "high")).alias(key)).distinct()  # two a range
    held = F.max(F.struct("at", *sums, *xors)).alias("held")
    parts = local.join(F.broadcast(spans), key).groupBy(key, "_range").agg(held)
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = {n: F.sum(f"held.{n}").over(earlier) for n in ["at", *sums]} | {n: F.bit_xor(f"held.{n}").over(earlier) for n in xors}
    offsets = parts.select(key, "_range", *(F.coalesce(v, F.lit(0)).alias(f"_{n}") for n, v in before.items()))
    placed = local.join(F.broadcast(offsets), [key, "_range"], "left")
    carried = lambda n: F.coalesce(f"_{n}", F.lit(0))
    return placed.select(key, *keep, *((F.col(n) + carried(n)).alias(n) for n in ["at", *sums]), *(F.col(n).bitwiseXOR(carried(n)).alias(n) for n in xors))
