"""A training-data pipeline over ``documents``: five stages, each an operator of the library.

What a stage has written for itself goes when its successor begins: by then its result is a table. The
successor keeps it if its documents still read from there, that is, if the result was not written.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from quoteloom.llm.common import drop_folder, fresh, own_folder, small_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

LEAST_PAGES = 10  # distinct pages of a source that hold a boilerplate line


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source.

    Copies of a text count once and a handful of pages makes no boilerplate, so that copies keep
    their lines for the next stage, which folds them.
    """
    own = fresh(docs)
    lines, dropped = f"{own}lines", f"{own}dropped"
    kept = line_dedup.drop_boilerplate(docs, least=LEAST_PAGES, copies=False, names=(lines, dropped))
    n_chars = F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).drop(lines, dropped)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return near_copies.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, in the order in which it is to be read."""
    return mixing.mix(docs)


_left = threading.local()  # the folder of the stage that this thread called last


def _tidy(number: int, stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        context, before, folder = getattr(_left, "stage", (None, None, None))
        if (context, before) == (spark.sparkContext.applicationId, number - 1):
            name = folder.rpartition("/")[2]
            if not any(name in path for path in docs.inputFiles()):
                drop_folder(spark, folder)
        with own_folder(spark) as folder:
            found = stage(spark, docs, sf_dir)
        _left.stage = (spark.sparkContext.applicationId, number, folder)
        return found

    return run


_IN_ORDER = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]
STAGES = [(name, _tidy(number, stage)) for number, (name, stage) in enumerate(_IN_ORDER)]

#: The factorization machine, the minima and the alignment are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix made of ``documents``; every stage's result is a Parquet table in the shared folder, and
    goes when the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with own_folder(spark) as folder:
            docs = written(stage(spark, docs, sf_dir))
        if last:
            drop_folder(spark, last)
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
