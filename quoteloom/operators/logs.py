"""Append-only logs: deduplication, attempt numbers, latest states and allowed transitions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quoteloom.functions.text import lookup, strip


def first_urls(rows: DataFrame, run: str, url: str, order: list[str]) -> DataFrame:
    """The first row of each stripped address of a run; blank addresses are never repeats."""
    key = strip(F.col(url))
    place = F.row_number().over(Window.partitionBy(run, key).orderBy(*order))
    return rows.withColumn("_place", place).where((F.col("_place") == 1) | F.coalesce(key == "", F.lit(True))).drop("_place")


def numbered(rows: DataFrame, run: str, order: list[str], name: str = "attempt_number") -> DataFrame:
    """Adds a dense number from 1 within a run."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


# The state that each review action asks for.
ACTIONS = {"confirm": "CONFIRMED", "reject": "REJECTED", "remove": "REJECTED", "undo": "UNREVIEWED"}


def review_events(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds state_before, outcome and state_after to review actions (``action``).

    A candidate starts UNREVIEWED. An action that asks for the present state is NO_CHANGE; confirm and
    reject are APPLIED to an unreviewed candidate and a CONFLICT otherwise (the state stays); remove is
    APPLIED from any state and so is undo. So undo and remove settle the state whatever was before, and
    of the confirms and rejects that follow one, the first decides if the state was left UNREVIEWED:
    two windows over the log tell it, with no loop over a candidate's events.
    """
    settled = F.when(F.col("action").isin("remove", "undo"), lookup(F.col("action"), ACTIONS))
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("_settled", settled)
    events = events.withColumns({"_since": F.count("_settled").over(earlier), "_base": F.coalesce(F.last("_settled", ignorenulls=True).over(earlier), F.lit("UNREVIEWED"))})
    votes = F.when(F.col("action").isin("confirm", "reject"), lookup(F.col("action"), ACTIONS))
    stretch = Window.partitionBy(*keys, "_since").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(votes, ignorenulls=True).over(stretch)
    before = F.when(F.col("_base") == "UNREVIEWED", F.coalesce(first, F.lit("UNREVIEWED"))).otherwise(F.col("_base"))
    events = events.withColumn("state_before", before).drop("_settled", "_since", "_base")
    wanted = lookup(F.col("action"), ACTIONS)
    free = F.col("action").isin("remove", "undo") | (F.col("state_before") == "UNREVIEWED")
    events = events.withColumn("outcome", F.when(wanted == F.col("state_before"), "NO_CHANGE").when(wanted.isNotNull() & free, "APPLIED").otherwise("CONFLICT"))
    return events.withColumn("state_after", F.when(F.col("outcome") == "APPLIED", wanted).otherwise(F.col("state_before")))


# Failures of the primary model after which the fallback is asked.
FALLBACK_AFTER = (
    "TIMEOUT", "DNS_ERROR", "TLS_ERROR", "CONNECTION_ERROR", "RATE_LIMITED", "HTTP_ERROR", "PROVIDER_UNAVAILABLE", "AUTHENTICATION_FAILED", "MODEL_NOT_FOUND",
    "EMPTY_RESPONSE", "MALFORMED_JSON", "SCHEMA_INVALID", "MODEL_IDENTITY_MISMATCH", "INVALID_RESPONSE",
)


def routed(attempts: DataFrame) -> DataFrame:
    """One answer a case from recorded attempts (case_id, role, outcome): the primary model's if it
    succeeded, else the fallback's if the primary failed in a way that allows one."""
    by = lambda role, what: F.max(F.when(F.col("role") == role, F.col(what)))
    wide = attempts.groupBy("case_id").agg(by("PRIMARY", "outcome").alias("primary"), by("FALLBACK", "outcome").alias("fallback"))
    retry = F.col("primary").isin(*FALLBACK_AFTER)
    used = F.when(F.col("primary") == "SUCCESS", "PRIMARY").when(retry & (F.col("fallback") == "SUCCESS"), "FALLBACK").otherwise("NONE")
    return wide.withColumn("answered_by", used)
