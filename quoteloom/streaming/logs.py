"""Append-only logs as streams: the newest entry of each key, kept up to date as files arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(entries: DataFrame, keys: list[str], order: list[str], *kept: str) -> DataFrame:
    """The newest entry of each key of a log, batch or stream. As a stream its state is one row a key
    (``order`` and ``kept`` columns), so it grows with the keys and not with the log."""
    last = F.max_by(F.struct(*kept), F.struct(*order))
    return entries.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def read(spark: SparkSession, folder: str, name: str, per_batch: int = 64) -> DataFrame:
    """The Parquet files of one table of a folder as a stream, ``per_batch`` files at a time."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parque[t]")


def caught_up(stream: DataFrame, folder: str, *columns: Column | str) -> DataFrame:
    """Runs a stream over all that is there now and returns the table of its state. ``folder`` must be
    shared by the cluster: progress and tables are kept there, so a restart goes on where it was."""
    table = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def save(state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(f"{table}/state-{batch}")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{table}/progress").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    spark = stream.sparkSession
    if last is None:
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(stream.schema).parquet(f"{table}/state-{last['batchId']}")
    return found.select(*columns) if columns else found
