"""Price buckets of accepted and confirmed listings, with exact decimals.

A bucket is a currency and condition of one run. Its amounts are gathered for the exact median; a
run's listings are few by nature (one product's offers), and only amounts are carried.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.operators.normalize import only

AMOUNT = "decimal(38,10)"


def exclusion_reason(eligible: Column) -> Column:
    """Why a row is in no bucket (the first reason that holds), or null."""
    c = F.col
    return (
        F.when(~eligible, "IDENTITY_NOT_ACCEPTED").when(c("price_amount").isNull(), "NO_NUMERIC_PRICE").when(c("currency_code").isNull(), "NO_COMPARABLE_CURRENCY").when(c("condition") == "UNKNOWN", "UNKNOWN_CONDITION")
    )


def median(amounts: Column) -> Column:
    """Exact median of an array of decimals, null for none."""
    ordered, n = F.array_sort(amounts), F.size(amounts)
    upper, lower = F.try_element_at(ordered, (F.floor(n / 2) + 1).cast("int")), F.try_element_at(ordered, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
    return ((upper.cast("decimal(30,8)") + lower.cast("decimal(30,8)")) / F.lit(2).cast("decimal(1,0)")).cast("decimal(38,9)")


def _groups(rows: DataFrame, eligible: Column | None = None, origin: Column | None = None) -> DataFrame:
    """Every currency and condition of a run with what its bucket holds, all its rows (``_rows``) and those
    that are in no bucket (``_left``)."""
    eligible = F.col("decision") == "ACCEPTED" if eligible is None else eligible
    origin = F.lit("DETERMINISTIC") if origin is None else origin
    # eligible rows are counted rather than filtered, so the long row expressions run once
    rows = rows.withColumns({"_origin": origin, "_reason": exclusion_reason(eligible)})
    inside = F.col("_reason").isNull()
    return rows.groupBy("run_id", "currency_code", "condition").agg(
        F.count("*").alias("_rows"),
        F.count("_reason").alias("_left"),
        F.count_if(inside).alias("listings"),
        F.min(F.when(inside, F.col("price_amount"))).alias("low"),
        F.max(F.when(inside, F.col("price_amount"))).alias("high"),
        F.collect_list(F.when(inside, F.col("price_amount"))).alias("_amounts"),
        F.count_if(inside & (F.col("_origin") == "DETERMINISTIC")).alias("deterministic_count"),
        F.count_if(inside & (F.col("_origin") == "HUMAN_CONFIRMED")).alias("human_confirmed_count"),
    )


def buckets(rows: DataFrame, eligible: Column | None = None, origin: Column | None = None) -> DataFrame:
    """run_id, currency_code, condition, listings, low, median, high, range_low, range_high,
    confidence, deterministic_count and human_confirmed_count."""
    return summarized(_groups(rows, eligible, origin).where("listings > 0").drop("_rows", "_left"))


def partition(rows: DataFrame, eligible: Column | None = None) -> DataFrame:
    """Assessments of each run, the amounts its buckets hold, and the rows with a reason for being in none,
    each counted by itself in one pass."""
    counts = {"assessments": F.col("_rows"), "bucketed": F.size("_amounts"), "excluded": F.col("_left")}
    return _groups(rows, eligible).groupBy("run_id").agg(*(F.sum(n).alias(name) for name, n in counts.items()))


def summarized(found: DataFrame) -> DataFrame:
    """Adds median, range_low, range_high and confidence to buckets with listings, low, high and their
    _amounts, which go."""
    many = F.col("listings") >= 3
    found = found.withColumn("median", median(F.col("_amounts"))).drop("_amounts")
    return found.withColumns({"range_low": F.when(many, F.col("low")), "range_high": F.when(many, F.col("high")), "confidence": F.when(many, "MEDIUM").otherwise("LOW")})


def exclusions(rows: DataFrame, eligible: Column | None = None) -> DataFrame:
    """The rows that are in no bucket, with their reason; with the buckets' rows all of ``rows``."""
    eligible = F.col("decision") == "ACCEPTED" if eligible is None else eligible
    return only(rows.withColumn("exclusion_reason", exclusion_reason(eligible)), F.col("exclusion_reason").isNotNull())


def status(rows: DataFrame, eligible: Column | None = None) -> DataFrame:
    """run_id, buckets, verification_status of every run, also those without a bucket."""
    eligible = F.col("decision") == "ACCEPTED" if eligible is None else eligible
    found = rows.withColumn("_in", exclusion_reason(eligible).isNull()).groupBy("run_id", "currency_code", "condition").agg(F.count_if("_in").alias("_n"))
    counted = found.groupBy("run_id").agg(F.count_if(F.col("_n") > 0).alias("buckets"))
    n = F.col("buckets")
    return counted.withColumn("verification_status", F.when(n == 0, "UNKNOWN").when(n == 1, "VERIFIED").otherwise("AMBIGUOUS"))


def repeated(rows: DataFrame) -> DataFrame:
    """Rows that occur more than once by value, each once with its count (they must not)."""
    return rows.groupBy(*rows.columns).count().where("count > 1")
