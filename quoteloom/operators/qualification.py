"""Scoring of recorded decisions against a corpus of three kinds of cases.

AUTHORITATIVE cases have one expected decision, AMBIGUOUS ones a set of acceptable ones, and
CONTRACT_NEGATIVE ones must be refused with an expected rejection.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "REVIEW")
STATES = ("EVALUATED", "RUNTIME_FAILURE", "CAPTURE_INTEGRITY_FAILURE", "NOT_INVOKED", "NOT_CAPTURED")


def outcomes(cases: DataFrame) -> DataFrame:
    """Adds verdict and severity, and settles state, of cases (case_class, state, expected, acceptable,
    hard_conflict, sales_unit, decision, rejection, expected_rejection)."""
    c = F.col
    negative, ambiguous = c("case_class") == "CONTRACT_NEGATIVE", c("case_class") == "AMBIGUOUS"
    refused = F.coalesce(c("rejection") == c("expected_rejection"), F.lit(False))
    state = F.when(negative, F.when(refused, "CONTRACT_REJECTED_OK").otherwise("CONTRACT_VIOLATION")).otherwise(c("state"))
    cases = cases.withColumn("state", state)
    defended = F.array_contains("acceptable", c("decision"))
    settled = F.when(c("decision") == c("expected"), "CORRECT").when(c("decision") == "MATCH", "FALSE_MATCH").when(c("decision") == "NO_MATCH", "FALSE_NO_MATCH").otherwise("ABSTAIN_ON_DEFINITE")
    scored = F.when(ambiguous, F.when(defended, "DEFENSIBLE").otherwise("OUTSIDE_DEFENSIBLE")).otherwise(settled)
    verdict = F.when(negative, F.when(refused, "REJECTED_AS_EXPECTED").otherwise("REJECTED_VIOLATION")).when(c("state") == "EVALUATED", scored)
    cases = cases.withColumn("verdict", verdict)
    unsafe = ((c("expected") == "NO_MATCH") & c("hard_conflict")) | c("sales_unit")
    severity = (
        F.when(c("verdict") == "REJECTED_VIOLATION", "CRITICAL")
        .when(c("verdict") == "FALSE_MATCH", F.when(unsafe, "CRITICAL").otherwise("HIGH"))
        .when(c("verdict") == "FALSE_NO_MATCH", F.when(c("expected") == "MATCH", "MEDIUM").otherwise("REVIEW"))
        .when(c("verdict") == "OUTSIDE_DEFENSIBLE", F.when(c("decision") == "MATCH", "HIGH").otherwise("REVIEW"))
        .when(c("verdict") == "ABSTAIN_ON_DEFINITE", "REVIEW")
    )
    return cases.withColumn("severity", severity)


def share(top: Column, bottom: Column) -> Column:
    """A ratio as text of six decimals, or ``unavailable`` where nothing is counted."""
    return F.when(bottom > 0, F.format_string("%.6f", top / bottom)).otherwise("unavailable")


def metrics(scored: DataFrame, *groups: str) -> DataFrame:
    """Accuracy of the evaluated authoritative cases, coverage, and counts of what went wrong."""
    c = F.col
    captured = c("case_class") != "CONTRACT_NEGATIVE"
    evaluated = captured & (c("state") == "EVALUATED")
    certain = evaluated & (c("case_class") == "AUTHORITATIVE")
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    said, wanted = (lambda d: certain & (c("decision") == d)), (lambda d: certain & (c("expected") == d))
    counts = {
        "eligible": captured, "evaluated": evaluated, "answered": captured & c("state").isin(*STATES[:4]), "_certain": certain, "_both": said("MATCH") & wanted("MATCH"), "_said": said("MATCH"), "_wanted": wanted("MATCH"),
        "_both_no": said("NO_MATCH") & wanted("NO_MATCH"), "_wanted_no": wanted("NO_MATCH"), "_uncertain": said("UNCERTAIN"), "false_matches": c("verdict") == "FALSE_MATCH", "false_no_matches": c("verdict") == "FALSE_NO_MATCH",
        "hard_false_matches": (c("verdict") == "FALSE_MATCH") & (c("expected") == "NO_MATCH") & c("hard_conflict"), "defensible": c("verdict") == "DEFENSIBLE", "contract_violations": c("state") == "CONTRACT_VIOLATION",
        **{s.lower(): c("severity") == s for s in SEVERITIES},
    }
    found = scored.groupBy(*groups).agg(*(count(v).alias(k) for k, v in counts.items()))
    shares = {"valid_rate": ("evaluated", "answered"), "match_precision": ("_both", "_said"), "match_recall": ("_both", "_wanted"), "no_match_accuracy": ("_both_no", "_wanted_no"), "uncertain_rate": ("_uncertain", "_certain"), "coverage": ("evaluated", "eligible")}
    found = found.withColumns({k: share(c(a), c(b)) for k, (a, b) in shares.items()})
    return found.drop(*(k for k in counts if k.startswith("_")))


def rollup(scored: DataFrame, *dimensions: str) -> DataFrame:
    """Totals by each dimension alone, in one pass: dimension, value, total, evaluated, correct,
    false_match, false_no_match and the states of the rest."""
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    rows = scored.where("case_class <> 'CONTRACT_NEGATIVE'")
    each = rows.select("state", "verdict", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))).alias("_d"))
    v, s = F.col("verdict"), F.col("state")
    return each.groupBy("_d.dimension", "_d.value").agg(
        F.count("*").alias("total"), count(s == "EVALUATED").alias("evaluated"), count((s == "EVALUATED") & v.isin("CORRECT", "DEFENSIBLE")).alias("correct"), count(v == "FALSE_MATCH").alias("false_match"),
        count(v == "FALSE_NO_MATCH").alias("false_no_match"), *(count(s == x).alias(x.lower()) for x in ("RUNTIME_FAILURE", "NOT_CAPTURED", "NOT_INVOKED")),
    )


def thresholds(found: DataFrame, bounds: DataFrame, *groups: str) -> DataFrame:
    """Each least bound (metric, bound) of a policy against the metrics of each group: met, not met, or
    null where the metric is unavailable. The policy names a handful of metrics."""
    names = ["valid_rate", "match_precision", "match_recall", "no_match_accuracy", "coverage"]
    long = found.select(*groups, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("_m")).select(*groups, "_m.*")
    met = F.col("value").try_cast("double") >= F.col("bound")
    return long.join(bounds, "metric").select(*groups, "metric", "value", "bound", met.alias("met"))
