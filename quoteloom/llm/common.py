"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python is given at most ``rows`` documents at a time, unless the session names a number: a batch
    stands in the JVM's native memory and in the worker's at once."""
    if spark.conf.get(BATCH) == "10000":  # Spark's own default
        spark.conf.set(BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of an input folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local one is chosen only where the session names none and runs in one process (tests, a
    laptop); on a cluster, whose executors would each write to a disk of their own, that is an
    error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quoteloom-")
        context.setCheckpointDir(named)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def own_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, which takes all tables that are ``written`` in the block."""
    path = f"{shared_dir(spark).rstrip('/')}/quoteloom-{uuid.uuid4().hex}"
    token = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(token)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost
    executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{(_FOLDER.get() or shared_dir(spark)).rstrip('/')}/quoteloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(*frames: DataFrame | list[str]) -> str:
    """A prefix that no column of ``frames`` starts with, for an operator's own columns."""
    taken = [c.lower() for f in frames for c in (f.columns if isinstance(f, DataFrame) else f)]
    prefix = "_q_"
    while any(c.startswith(prefix) for c in taken):
        prefix = f"_{prefix}"
    return prefix


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its columns of these names, in any case: an operator's results replace them."""
    drop = {n.lower() for n in names}
    return df.select(*(named(c) for c in df.columns if c.lower() not in drop))


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ...: ``mapInArrow`` cannot read some names."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each Column of ``sums`` over all rows before it in ``order``.

    The rows are range-sorted over the cluster; each range is summed from its own start and gets the
    total of the ranges before, so no task holds more than a range. Ties in ``order`` are allowed
    only between rows whose order does not matter.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select(F.col("_range").alias("_of"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    return placed.select(*(named(c) for c in rows.columns), *((F.col(f"_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(n) for n, c in sums.items()))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the offsets of its rows (a null is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a partition (they must be few and narrow), or None."""
    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows).combine_chunks() if rows else None


def column(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """A column without nulls as a numpy array."""
    return rows.column(name).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(name).to_numpy()


#: DuckDB: the table of crc32, as a list, from its rule; ``crc32_sql`` looks bytes up in it.
CRC32_SQL = """crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS entries
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)
)"""


def crc32_sql(text: str) -> str:
    """DuckDB: the crc32 of a string column, next to ``crc``."""
    each = f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST('0x' || substr(hex({text}), CAST(2 * i - 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {each}), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295)"
