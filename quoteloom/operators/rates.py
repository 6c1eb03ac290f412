"""Which stored exchange-rate observation may be used again."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quoteloom.functions.fx import only_weekend


def asof_latest(requests: DataFrame, observations: DataFrame) -> DataFrame:
    """Each request (request_id, asked_on) with the newest observation (observation_id,
    observed_on, last_proven_on, currencies) proven by then, and whether it may be used again:
    only weekend days lie between its last proof and the request.

    A request needs one day's answer, so requests meet observations by day: the newest observation
    of each day is carried forward over the calendar by one window, not by a range join.
    """
    days = requests.select(F.col("asked_on").alias("day"), "request_id", F.lit(None).cast("struct<observed_on:date,proven:date,id:long>").alias("seen"))
    seen = F.struct(F.col("observed_on"), F.col("last_proven_on").alias("proven"), F.col("observation_id").alias("id"))
    facts = observations.groupBy(F.col("last_proven_on").alias("day")).agg(F.max(seen).alias("seen")).select("day", F.lit(None).cast("long").alias("request_id"), "seen")
    # requests of a day meet as one row; the calendar is what one task orders
    calendar = days.select("day").distinct().join(facts.select("day", "seen"), "day", "full_outer")
    newest = F.max("seen").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    latest = calendar.select("day", newest.alias("seen"))
    found = requests.join(latest, requests["asked_on"] == latest["day"], "left")
    proven = F.col("seen.proven")
    again = F.coalesce(F.col("asked_on") == proven, F.lit(False)) | F.coalesce(only_weekend(F.date_add(proven, 1), F.col("asked_on")), F.lit(False))
    return found.select("request_id", "asked_on", F.col("seen.id").alias("observation_id"), F.col("seen.observed_on").alias("observed_on"), again.alias("reusable"))


def projected(rates: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """``rates`` of the required currency codes (upper case after trimming), or all of them."""
    if required is None:
        return rates
    wanted = required.select(F.upper(F.trim("currency_code")).alias("_code")).distinct()
    return rates.join(wanted, F.col("currency_code") == F.col("_code"), "left_semi")


def reusable(observations: DataFrame, required: list[str]) -> DataFrame:
    """The newest observation of each feed (observation_id, feed_id, observed_on, proven_on, asked_on,
    codes), of several the one of the largest id, and whether it may be used: no working day lies between
    its proof and the request, and its codes hold every required one. An older observation is not looked
    at if the newest fails."""
    newest = F.row_number().over(Window.partitionBy("feed_id").orderBy(F.desc("observed_on"), F.desc("proven_on"), F.desc("observation_id")))
    rows = observations.withColumn("_place", newest).where("_place = 1").drop("_place")
    fresh = (F.col("proven_on") == F.col("asked_on")) | F.coalesce(only_weekend(F.date_add("proven_on", 1), F.col("asked_on")), F.lit(False))
    missing = F.size(F.array_except(F.array(*(F.lit(c.strip().upper()) for c in required)), "codes"))
    return rows.withColumn("outcome", F.when(~fresh, "STALE").when(missing > 0, "COVERAGE_GAP").otherwise("REUSABLE"))
