"""Scores of recorded judgements against expected ones, gates and leaderboards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("MATCH", "NON_MATCH", "UNCERTAIN")


def ratio(top: Column, bottom: Column) -> Column:
    """0 where nothing is counted."""
    return F.when(bottom > 0, F.round(top / bottom, 6)).otherwise(0.0)


def _cell(expected: str, predicted: str) -> Column:
    return F.count_if((F.col("expected") == expected) & (F.col("predicted") == predicted) & F.col("valid"))


def metrics(judgements: DataFrame, *groups: str) -> DataFrame:
    """Confusion counts and metrics of (expected, predicted, valid), by ``groups`` or in all.

    The safety cost is ten for each false match, and one for each other error but an undecided
    prediction on an undecided case.
    """
    cells = {f"{e[0].lower()}_{p[0].lower()}": _cell(e, p) for e in CLASSES for p in CLASSES}
    found = judgements.groupBy(*groups).agg(F.count("*").alias("cases"), F.count_if("valid").alias("valid_cases"), *(v.alias(k) for k, v in cells.items()))
    c = F.col
    right = c("m_m") + c("n_n") + c("u_u")
    false_match = c("n_m") + c("u_m")
    out = {"valid_rate": ratio(c("valid_cases"), c("cases")), "accuracy": ratio(right, c("valid_cases"))}
    for x in "mnu":
        out[f"precision_{x}"] = ratio(c(f"{x}_{x}"), c(f"m_{x}") + c(f"n_{x}") + c(f"u_{x}"))
        out[f"recall_{x}"] = ratio(c(f"{x}_{x}"), c(f"{x}_m") + c(f"{x}_n") + c(f"{x}_u"))
    out |= {"false_matches": false_match, "false_match_rate": ratio(false_match, c("n_m") + c("n_n") + c("n_u") + c("u_m") + c("u_n") + c("u_u"))}
    out["safety_cost"] = 10 * false_match + (c("m_n") + c("m_u") + c("n_u") + c("u_n"))
    return found.withColumns(out)


def gates(found: DataFrame) -> DataFrame:
    """Adds the quality gates of a metrics row, and whether all hold."""
    c = F.col
    out = {"gate_no_false_match": c("false_matches") == 0, "gate_valid": c("valid_rate") >= 0.99, "gate_precision": c("precision_m") >= 0.98, "gate_accuracy": c("accuracy") >= 0.90}
    found = found.withColumns(out)
    passed = F.lit(True)
    for g in out:
        passed = passed & c(g)
    return found.withColumn("gates_passed", passed)


def scored(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Cases with their response by case_id: status ANSWERED, MISSING (no response) or UNKNOWN_CASE
    (a response to no case, which must not be)."""
    joined = cases.withColumn("_case", F.lit(True)).join(responses.withColumn("_answer", F.lit(True)), "case_id", "full_outer")
    return joined.withColumn("status", F.when(F.col("_case").isNull(), "UNKNOWN_CASE").when(F.col("_answer").isNull(), "MISSING").otherwise("ANSWERED")).drop("_case", "_answer")


def leaderboard(runs: DataFrame, top: int = 20) -> DataFrame:
    """The best ``top`` runs: gates, then fewest false matches, precision, recall, accuracy."""
    return runs.orderBy(F.desc("gates_passed"), "false_matches", F.desc("precision_m"), F.desc("recall_m"), F.desc("accuracy"), "run_id").limit(top)


def distribution(cases: DataFrame, *dimensions: str) -> DataFrame:
    """Counts by each dimension alone, and in all, in one pass: dimension, value, cases."""
    cube = cases.groupingSets([[d] for d in dimensions] + [[]], *dimensions).agg(F.count("*").alias("cases"), F.grouping_id().alias("_id"))
    n = len(dimensions)
    name, value = F.lit("all"), F.lit(None).cast("string")
    for k, d in enumerate(dimensions):
        mine = F.col("_id") == ((1 << n) - 1 - (1 << (n - 1 - k)))
        name, value = F.when(mine, d).otherwise(name), F.when(mine, F.col(d).cast("string")).otherwise(value)
    return cube.select(name.alias("dimension"), value.alias("value"), "cases")


def decision(policy_status: Column, hard_gates: Column, coverage: Column, thresholds: Column) -> Column:
    """Qualification of a run; ``thresholds`` is null where one cannot be told."""
    return (
        F.when(~hard_gates, "NOT_QUALIFIED").when(policy_status == "DRAFT", "POLICY_PENDING").when(~coverage, "INCOMPLETE_COVERAGE").when(thresholds.isNull(), "THRESHOLD_INDETERMINATE").when(~thresholds, "BELOW_THRESHOLD").otherwise("QUALIFIED")
    )


def compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two runs case by case: SAME, CHANGED, ONLY_FIRST or ONLY_SECOND."""
    a, b = one.select("case_id", F.col("predicted").alias("first")), two.select("case_id", F.col("predicted").alias("second"))
    joined = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "case_id", "full_outer")
    change = F.when(F.col("_a").isNull(), "ONLY_SECOND").when(F.col("_b").isNull(), "ONLY_FIRST").when(F.col("first").eqNullSafe(F.col("second")), "SAME").otherwise("CHANGED")
    return joined.select("case_id", "first", "second", change.alias("change"))
