"""Queries over catalogs, aliases, vendor offers, all quote sections, evidence and reviews."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.functions import commerce, quote
from quoteloom.functions.specs import spelled_once
from quoteloom.operators import aggregate, aliases, authority, evaluation, match, qualification, quotes, specs
from quoteloom.operators.rates import projected, reusable
from quoteloom.plans.authority import _STATE_SQL, OFFERS
from quoteloom.plans.evidence import CASES, OBSERVATION_SQL, OBSERVATIONS
from quoteloom.plans.market import _ROW, ACCEPTED, ASSESS_SQL, assessed
from quoteloom.sources import captured
from quoteloom.sources.adapters import rates, view
from quoteloom.streaming import logs

SEARCH = "https://shop.example/search?q="
CATALOGS = """
SELECT p_partkey AS document_id, '{"date":"2024-01-01","details":[{"part-number":"M' || CAST(p_partkey AS STRING) || '","part-name":"' || p_name || '","attr":[' ||
  CASE p_partkey % 5 WHEN 0 THEN '{"id":"is-ssd","value":true}' WHEN 1 THEN '{"id":"is-ssd","value":false}' WHEN 2 THEN '' WHEN 3 THEN '{"id":"is-ssd","value":true},{"id":"is-ssd","value":"true"}'
    ELSE '{"id":"other","value":1},{"id":"is-ssd","value":true},{"id":"is-ssd","value":true}' END || ']},{"part-name":"no number"},{"part-number":""},{"part-number":7},{"part-number":"N' || CAST(p_partkey AS STRING) || '"}]}' AS raw
FROM part
"""
ASKED = """
SELECT p_partkey, 'M' || CAST(p_partkey AS STRING) AS base, CASE p_partkey % 6 WHEN 0 THEN 'M' || CAST(p_partkey AS STRING) WHEN 1 THEN 'M' || CAST(p_partkey AS STRING) || 'R' WHEN 2 THEN ' M' || CAST(p_partkey AS STRING) || 'T'
  WHEN 3 THEN 'm' || CAST(p_partkey AS STRING) WHEN 4 THEN 'M' || CAST(p_partkey AS STRING) || 'X' ELSE 'm' || CAST(p_partkey AS STRING) || 'r' END AS requested_mpn,
  CASE p_partkey % 4 WHEN 0 THEN 'M' || CAST(p_partkey AS STRING) || 'T' WHEN 1 THEN ' m' || CAST(p_partkey AS STRING) WHEN 2 THEN 'other' ELSE '' END AS published,
  CASE p_partkey % 7 WHEN 0 THEN 'DDR5-6400 rdimm module' WHEN 1 THEN 'XDDR5Y DIMMed' WHEN 2 THEN 'a drop-in drive' WHEN 3 THEN 'Compatible with dimm' WHEN 4 THEN 'incompatible' WHEN 5 THEN NULL ELSE p_name END AS description
FROM part
"""
SOURCE = "SELECT 'd' || CAST(p_size AS STRING) AS policy_id, 'PN ' || CAST(p_partkey % 700 AS STRING) AS source_mpn FROM part"
SOUGHT = "SELECT DISTINCT 'd' || CAST(p_size AS STRING) AS policy_id, 'pn-' || CAST(p_partkey % 900 AS STRING) AS requested_mpn FROM part"
EVIDENCE = """
SELECT p_partkey, p_partkey % 3 <> 0 AS titled, CASE p_partkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('CAPACITY') WHEN 2 THEN array('CAPACITY', 'CAPACITY') ELSE array('CAPACITY', 'INTERFACE') END AS dimensions,
  CASE p_partkey % 5 WHEN 0 THEN array('MANUFACTURER_PRODUCT_CONTEXT') WHEN 1 THEN array('CUSTOMER_RETRIEVAL_RELATION') ELSE array() END AS provenances, p_size % 7 = 0 AND p_partkey % 4 <> 0 AS from_context FROM part
"""
CORPUS = """
SELECT doc_id AS case_id, 'run' || CAST(doc_id % 20 AS STRING) AS run_id, CASE doc_id % 6 WHEN 4 THEN 'AMBIGUOUS' WHEN 5 THEN 'CONTRACT_NEGATIVE' ELSE 'AUTHORITATIVE' END AS case_class, 'U' || CAST(doc_id % 5 AS STRING) AS substate,
  CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, CASE doc_id % 9 WHEN 0 THEN 'RUNTIME_FAILURE' WHEN 1 THEN 'NOT_CAPTURED' WHEN 2 THEN 'NOT_INVOKED' ELSE 'EVALUATED' END AS state,
  CASE WHEN doc_id % 6 > 3 THEN NULL WHEN toxic = 1 THEN 'MATCH' WHEN quality = 0 THEN 'UNCERTAIN' ELSE 'NO_MATCH' END AS expected,
  CASE WHEN doc_id % 4 = 0 THEN array('MATCH', 'UNCERTAIN') ELSE array('NO_MATCH') END AS acceptable, doc_id % 3 = 0 AS hard_conflict, doc_id % 7 = 0 AS sales_unit,
  CASE doc_id % 5 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'NO_MATCH' WHEN 2 THEN 'UNCERTAIN' WHEN 3 THEN 'NO_MATCH' ELSE 'MATCH' END AS decision,
  CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'OTHER' ELSE 'NO_TITLE' END AS rejection, 'NO_TITLE' AS expected_rejection
FROM labels
"""
PROVEN = """
SELECT event_id AS observation_id, 'f' || CAST(event_id % 50 AS STRING) AS feed_id, DATE '2024-01-01' + CAST(event_id % 27 AS INT) AS observed_on, DATE '2024-01-01' + CAST(event_id % 27 AS INT) AS proven_on, DATE '2024-01-28' AS asked_on,
  CASE event_id % 3 WHEN 0 THEN array('USD') ELSE array('GBP', 'JPY', 'USD') END AS codes
FROM events WHERE event_id % 41 = 0
"""


def catalog_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured.catalog_records(view(spark, sf_dir, CATALOGS))


def packaging_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias relation of requests, the query that it widens, and what refers to an alias."""
    rows = view(spark, sf_dir, ASKED, part="p_partkey").withColumn("names", aliases.aliases(F.col("requested_mpn"), F.col("base")))
    query = captured.search_query(F.col("requested_mpn"), F.col("description"), F.coalesce("names", F.array().cast("array<string>")))
    return rows.select("p_partkey", F.array_join("names", ",").alias("aliases"), query.alias("query"), aliases.reference(F.col("names"), F.col("published")).alias("reference"))


def description_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, ASKED, part="p_partkey")
    return rows.select("p_partkey", F.array_join(aliases.module_words(F.col("description")), ",").alias("module_words"), aliases.compatibility_wording(F.col("description")).alias("compatible"))


def search_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT p_partkey, p_name || '/#' || p_brand || '~*' || CAST(p_partkey AS STRING) AS mpn FROM part")
    return rows.select("p_partkey", captured.search_address(SEARCH, F.col("mpn")).alias("address"))


def source_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.source_outcome(view(spark, sf_dir, SOURCE), view(spark, sf_dir, SOUGHT))


def _bound(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    requests = view(spark, sf_dir, "SELECT 'r' || CAST(p_partkey AS STRING) AS run_id, 'mz' || CAST(p_partkey AS STRING) AS requested_mpn FROM part")
    return captured.bound_offers(captured.vendor_offers(view(spark, sf_dir, OFFERS)), requests)


def vendor_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers that are the requested part, and the issues of all others, in one table."""
    kept, issues = _bound(spark, sf_dir)
    kept = kept.select("run_id", "source_name", "match_type", "brand_new_basis", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("detail"))
    return kept.unionByName(issues, allowMissingColumns=True)


def quote_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five sections: vendor offers, confirmed, unreviewed, public, and accepted listings of unknown
    condition, which are quoted but in no bucket."""
    rows = assessed(spark, sf_dir).withColumn("amount_text", F.col("price_amount").cast("decimal(38,2)").cast("string"))
    open_rows = F.col("price_amount").isNotNull() & F.col("currency_code").isNotNull() & match.reviewable()
    reason = aggregate.exclusion_reason(F.col("decision") == "ACCEPTED")
    even = F.col("url_ord") % 2 == 0
    section = F.when(reason.isNull(), "PUBLIC").when(reason == "UNKNOWN_CONDITION", "QUOTE_ONLY").when(open_rows & even, "HUMAN_CONFIRMED").when(open_rows, "AI_UNREVIEWED")
    listed = quotes.rows(rows, section)
    kept, _ = _bound(spark, sf_dir)
    vendor = kept.select(
        "run_id",
        F.lit(0).alias("section_ord"),
        F.lit("VENDOR").alias("section"),
        F.col("source_name").alias("source"),
        quote.price_text(F.col("price").cast("decimal(38,2)").cast("string"), F.col("currency_code")).alias("price_text"),
        F.col("price").alias("price_amount"),
        "currency_code",
        commerce.inventory_label(F.col("availability")).alias("inventory"),
        F.lit("Yes").alias("brand_new"),
        F.lit(None).cast("string").alias("note"),
    )
    return vendor.unionByName(listed)


def public_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that may be shown to anyone: how many rows of each a run has, without vendors'."""
    return quote_sections(spark, sf_dir).where("section <> 'VENDOR'").groupBy("run_id", "section").agg(F.count("*").alias("rows"))


def projected_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = view(spark, sf_dir, "SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN ' usd' WHEN 1 THEN 'GBP ' ELSE 'XXX' END AS currency_code FROM nation")
    return projected(rates(spark), required)


def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, EVIDENCE)
    return rows.select("p_partkey", authority.evidence_quality(F.col("titled"), F.col("dimensions"), F.col("provenances"), F.col("from_context")).alias("quality"))


def resolution_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = authority.identity_state(assessed(spark, sf_dir))
    granted = F.when(F.col("url_ord") % 13 == 0, F.array(F.lit(authority.RELATION_GRANT))).otherwise(F.array().cast("array<string>"))
    bound = authority.resolution_bound(F.col("substate"), F.col("signal"), F.col("listing_ord") % 2 == 0, granted)
    return rows.groupBy("substate", "signal", bound.alias("bound")).agg(F.count("*").alias("listings"))


def bound_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded reviews that still fit the assessment they name; every fifth has another title."""
    rows = match.indexed(assessed(spark, sf_dir), "run_id", "url_ord", "listing_ord")
    copied = ["source_url", "requested_mpn", "product_title", "mpn_text", "sku_text", "evidence_source"]
    title = F.when(F.col("url_ord") % 5 == 0, "another").otherwise(F.col("product_title"))
    reviews = rows.where("listing_ord % 2 = 0").withColumns({"product_title": title, "sku_text": F.coalesce("sku_text", F.lit(""))})
    reviews = reviews.select("run_id", "assessment_index", *copied, F.lit("CONFIRMED").alias("review_state"), F.lit("HIGH").alias("semantic_confidence"), F.array().cast("array<string>").alias("conflicting_attributes"))
    return match.bound_reviews(rows, reviews).select("run_id", "assessment_index", "url_ord", "listing_ord", "review_state")


def scored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = view(spark, sf_dir, CASES).select("case_id", "expected")
    responses = view(spark, sf_dir, CASES).select(F.when(F.col("case_id") % 10 == 3, -F.col("case_id")).otherwise(F.col("case_id")).alias("case_id"), "predicted").where("case_id % 7 <> 0")
    return evaluation.scored(cases, responses).groupBy("status").agg(F.count("*").alias("cases"))


def run_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualification of each run from its gates, coverage and thresholds."""
    runs = evaluation.gates(evaluation.metrics(view(spark, sf_dir, CASES), "run_id"))
    number = F.substring("run_id", 4, 9).cast("int")
    policy = F.when(number % 5 == 0, "DRAFT").otherwise("APPROVED")
    threshold = F.when(number % 3 != 0, F.col("accuracy") >= 0.5)
    return runs.select("run_id", evaluation.decision(policy, F.col("false_matches") < 3, F.col("cases") >= 2, threshold).alias("decision"))


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.repeated(view(spark, sf_dir, "SELECT user_id, event_type, CAST(event_id % 3 AS BIGINT) AS part FROM events"))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type, by a stream over the event files."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    newest = logs.newest(logs.read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    return logs.caught_up(newest, shared or tempfile.mkdtemp(prefix="quoteloom-"))


def case_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qualification.outcomes(view(spark, sf_dir, CORPUS))
    return rows.select("case_id", "state", "verdict", "severity")


def outcome_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualification.metrics(qualification.outcomes(view(spark, sf_dir, CORPUS)), "run_id")


def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualification.rollup(qualification.outcomes(view(spark, sf_dir, CORPUS)), "substate", "category")


def policy_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = spark.sql("SELECT * FROM (VALUES ('match_precision', 0.4D), ('coverage', 0.5D), ('match_recall', 0.3D)) AS t(metric, bound)")
    return qualification.thresholds(outcome_metrics(spark, sf_dir), bounds, "run_id")


def united_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolutions of two overlapping sets of evidence, and what each product lacks."""
    every = spelled_once(view(spark, sf_dir, OBSERVATIONS)).drop("raw_value")
    one, two = every.where("definition_key <> 'capacity'"), every.where("source_authority = 'AUTHORITATIVE'")
    return specs.coverage(specs.resolve(specs.united(one, two)), ["capacity", "sequential_read", "storage_protocol"])


def reusable_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reusable(view(spark, sf_dir, PROVEN), [" usd", "GBP"]).select("feed_id", "observed_on", "outcome")


QUERIES = {
    f.__name__: f
    for f in (catalog_records, packaging_aliases, description_evidence, search_addresses, source_outcomes, vendor_bindings, quote_sections, public_sections, projected_rates, evidence_quality, resolution_bounds, bound_reviews, scored_cases, run_decisions, repeated_events, streamed_events, case_outcomes, outcome_metrics, outcome_rollup, policy_thresholds, united_specs, reusable_rates)
}

_OFFER = "SELECT 'r' || p_partkey AS run_id, 'MZ' || p_partkey AS mpn, p_partkey FROM part"
_SECTIONS = f"""{ASSESS_SQL}, quoted AS (
SELECT 'r' || p_partkey AS run_id, 0 AS section_ord, 'VENDOR' AS section, 'A' AS source, '$12.50 USD' AS price_text, CAST(12.5 AS DECIMAL(38,10)) AS price_amount, 'USD' AS currency_code, 'In Stock' AS inventory, 'Yes' AS brand_new, CAST(NULL AS VARCHAR) AS note FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT 'r1', 0, 'VENDOR', 'A', '€9.75 EUR', CAST(9.75 AS DECIMAL(38,10)), 'EUR', 'Out of Stock', 'Yes', NULL FROM part WHERE p_partkey = 1
UNION ALL SELECT run_id, 1, 'HUMAN_CONFIRMED', {_ROW} FROM assessed WHERE reviewable AND confirmed_vote AND price_amount IS NOT NULL AND currency_code IS NOT NULL
UNION ALL SELECT run_id, 2, 'AI_UNREVIEWED', {_ROW} FROM assessed WHERE reviewable AND NOT confirmed_vote AND price_amount IS NOT NULL AND currency_code IS NOT NULL
UNION ALL SELECT run_id, 3, 'PUBLIC', {_ROW} FROM assessed WHERE {ACCEPTED} IS NULL
UNION ALL SELECT run_id, 4, 'QUOTE_ONLY', {_ROW} FROM assessed WHERE {ACCEPTED} = 'UNKNOWN_CONDITION')"""
_METRICS = f"""SELECT run_id, count(*) AS cases, count(*) FILTER (valid) AS v, count(*) FILTER (valid AND expected = predicted) AS hit,
  count(*) FILTER (valid AND predicted = 'MATCH' AND expected <> 'MATCH') AS false_matches FROM ({CASES}) GROUP BY run_id"""

_OUTCOME = f"""WITH corpus AS ({CORPUS.replace('array(', 'list_value(')}), outcome AS (
  SELECT * EXCLUDE (state), CASE WHEN case_class <> 'CONTRACT_NEGATIVE' THEN state WHEN rejection = 'NO_TITLE' THEN 'CONTRACT_REJECTED_OK' ELSE 'CONTRACT_VIOLATION' END AS state,
    CASE WHEN case_class = 'CONTRACT_NEGATIVE' THEN CASE WHEN rejection = 'NO_TITLE' THEN 'REJECTED_AS_EXPECTED' ELSE 'REJECTED_VIOLATION' END WHEN state <> 'EVALUATED' THEN NULL
      WHEN case_class = 'AMBIGUOUS' THEN CASE WHEN list_contains(acceptable, decision) THEN 'DEFENSIBLE' ELSE 'OUTSIDE_DEFENSIBLE' END
      WHEN decision = expected THEN 'CORRECT' WHEN decision = 'UNCERTAIN' THEN 'ABSTAIN_ON_DEFINITE' ELSE 'FALSE_' || decision END AS verdict FROM corpus
), judged AS (
  SELECT *, CASE verdict WHEN 'REJECTED_VIOLATION' THEN 'CRITICAL' WHEN 'ABSTAIN_ON_DEFINITE' THEN 'REVIEW' WHEN 'FALSE_MATCH' THEN CASE WHEN sales_unit OR (expected = 'NO_MATCH' AND hard_conflict) THEN 'CRITICAL' ELSE 'HIGH' END
    WHEN 'FALSE_NO_MATCH' THEN CASE expected WHEN 'MATCH' THEN 'MEDIUM' ELSE 'REVIEW' END WHEN 'OUTSIDE_DEFENSIBLE' THEN CASE decision WHEN 'MATCH' THEN 'HIGH' ELSE 'REVIEW' END END AS severity FROM outcome
)"""
_SHARE = lambda a, b: f"CASE WHEN count(*) FILTER ({b}) > 0 THEN format('{{:.6f}}', count(*) FILTER ({a}) / count(*) FILTER ({b})) ELSE 'unavailable' END"
_ELIGIBLE = "case_class <> 'CONTRACT_NEGATIVE'"
_EVALUATED = f"{_ELIGIBLE} AND state = 'EVALUATED'"
_SURE = "case_class = 'AUTHORITATIVE' AND state = 'EVALUATED'"
_ANSWERED = f"{_ELIGIBLE} AND state <> 'NOT_CAPTURED'"
_OUTCOME_METRICS = f"""{_OUTCOME}, metric AS (SELECT run_id, count(*) FILTER ({_ELIGIBLE}) AS eligible, count(*) FILTER ({_EVALUATED}) AS evaluated, count(*) FILTER ({_ANSWERED}) AS answered,
  count(*) FILTER (verdict = 'FALSE_MATCH') AS false_matches, count(*) FILTER (verdict = 'FALSE_NO_MATCH') AS false_no_matches, count(*) FILTER (verdict = 'FALSE_MATCH' AND expected = 'NO_MATCH' AND hard_conflict) AS hard_false_matches,
  count(*) FILTER (verdict = 'DEFENSIBLE') AS defensible, count(*) FILTER (state = 'CONTRACT_VIOLATION') AS contract_violations,
  count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'REVIEW') AS review,
  {_SHARE(_EVALUATED, _ANSWERED)} AS valid_rate, {_SHARE(f"{_SURE} AND decision = 'MATCH' AND expected = 'MATCH'", f"{_SURE} AND decision = 'MATCH'")} AS match_precision,
  {_SHARE(f"{_SURE} AND decision = 'MATCH' AND expected = 'MATCH'", f"{_SURE} AND expected = 'MATCH'")} AS match_recall, {_SHARE(f"{_SURE} AND decision = 'NO_MATCH' AND expected = 'NO_MATCH'", f"{_SURE} AND expected = 'NO_MATCH'")} AS no_match_accuracy,
  {_SHARE(f"{_SURE} AND decision = 'UNCERTAIN'", _SURE)} AS uncertain_rate, {_SHARE(_EVALUATED, _ELIGIBLE)} AS coverage FROM judged GROUP BY run_id)"""
_TALLY = "count(*) AS total, count(*) FILTER (state = 'EVALUATED') AS evaluated, count(*) FILTER (verdict IN ('CORRECT', 'DEFENSIBLE')) AS correct, count(*) FILTER (verdict = 'FALSE_MATCH') AS false_match, count(*) FILTER (verdict = 'FALSE_NO_MATCH') AS false_no_match, count(*) FILTER (state = 'RUNTIME_FAILURE') AS runtime_failure, count(*) FILTER (state = 'NOT_CAPTURED') AS not_captured, count(*) FILTER (state = 'NOT_INVOKED') AS not_invoked"

ORACLES = {
    "case_outcomes": f"{_OUTCOME} SELECT case_id, state, verdict, severity FROM judged",
    "outcome_metrics": f"{_OUTCOME_METRICS} SELECT * FROM metric",
    "outcome_rollup": f"{_OUTCOME} SELECT 'substate' AS dimension, substate AS value, {_TALLY} FROM judged WHERE {_ELIGIBLE} GROUP BY 2 UNION ALL SELECT 'category', category, {_TALLY} FROM judged WHERE {_ELIGIBLE} GROUP BY 2",
    "policy_thresholds": f"""{_OUTCOME_METRICS}, long AS (SELECT run_id, 'match_precision' AS metric, match_precision AS value, CAST(0.4 AS DOUBLE) AS bound FROM metric
UNION ALL SELECT run_id, 'coverage', coverage, 0.5 FROM metric UNION ALL SELECT run_id, 'match_recall', match_recall, 0.3 FROM metric) SELECT *, TRY_CAST(value AS DOUBLE) >= bound AS met FROM long""",
    "united_specs": f"""{OBSERVATION_SQL}, told AS (SELECT * FROM norm WHERE definition_key <> 'capacity' OR source_authority = 'AUTHORITATIVE'), has AS (
  SELECT product_id, definition_key, count(DISTINCT coalesce(txt, CAST(dec AS VARCHAR))) FILTER (issue IS NULL) = 1 AS good FROM told GROUP BY 1, 2
) SELECT product_id, array_to_string(list_filter(['capacity', 'sequential_read', 'storage_protocol'], lambda k: NOT list_contains(coalesce(list(definition_key) FILTER (good), []), k)), ',') AS missing,
  count(*) FILTER (good AND definition_key IN ('capacity', 'sequential_read', 'storage_protocol')) = 3 AS complete FROM has GROUP BY product_id""",
    "reusable_rates": f"""WITH p AS ({PROVEN.replace('array(', 'list_value(')}) SELECT feed_id, observed_on, CASE WHEN proven_on < DATE '2024-01-26' THEN 'STALE' WHEN NOT list_contains(codes, 'GBP') THEN 'COVERAGE_GAP' ELSE 'REUSABLE' END AS outcome
FROM p QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY observed_on DESC, proven_on DESC, observation_id DESC) = 1""",
    "catalog_records": """SELECT p_partkey AS document_id, 0 AS row, 'M' || p_partkey AS part_number, p_name AS part_name, p_partkey % 5 IN (0, 4) AS is_drive FROM part
UNION ALL SELECT p_partkey, 4, 'N' || p_partkey, '', false FROM part""",
    "packaging_aliases": f"""WITH a AS ({ASKED}), n AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN ['R', 'T'] WHEN 1 THEN ['', 'T'] WHEN 2 THEN ['', 'R'] WHEN 3 THEN ['R', 'T'] END AS ends FROM a)
SELECT p_partkey, array_to_string(list_transform(ends, lambda x: base || x), ',') AS aliases,
  CASE WHEN ends IS NULL THEN '"' || trim(requested_mpn) || '"' ELSE '("' || trim(requested_mpn) || '" OR "' || base || ends[1] || '" OR "' || base || ends[2] || '")' END || coalesce(' ' || description, '') AS query,
  CASE WHEN p_partkey % 4 = 0 AND list_contains(ends, 'T') THEN base || 'T' WHEN p_partkey % 4 = 1 AND list_contains(ends, '') THEN base END AS reference FROM n""",
    "description_evidence": "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'DDR5,RDIMM' WHEN 3 THEN 'DIMM' ELSE '' END AS module_words, p_partkey % 7 IN (2, 3) AS compatible FROM part",
    "search_addresses": f"SELECT p_partkey, '{SEARCH}' || replace(p_name, ' ', '%20') || '%2F%23' || replace(p_brand, '#', '%23') || '~%2A' || p_partkey AS address FROM part",
    "source_outcomes": f"""WITH s AS (SELECT policy_id, replace(source_mpn, ' ', '-') AS k, count(*) AS n, min(source_mpn) AS one FROM ({SOURCE}) GROUP BY 1, 2)
SELECT q.policy_id, q.requested_mpn, CASE WHEN n IS NULL THEN 'NO_MPN_IN_SOURCE' WHEN n > 1 THEN 'AMBIGUOUS_MPN_MATCH' ELSE 'MATCHED' END AS outcome, CASE WHEN n = 1 THEN one END AS source_mpn
FROM ({SOUGHT}) q LEFT JOIN s ON s.policy_id = q.policy_id AND s.k = upper(q.requested_mpn)""",
    "vendor_bindings": """SELECT 'r' || p_partkey AS run_id, 'A' AS source_name, CASE WHEN p_partkey % 6 = 0 OR p_partkey = 1 THEN 'NORMALIZED_EXACT' END AS match_type, CASE WHEN p_partkey % 6 = 0 OR p_partkey = 1 THEN 'VENDOR_API_POLICY' END AS brand_new_basis,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN p_partkey <> 1 THEN 'MPN_MISMATCH' END WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN 'PRICE_MISSING' WHEN 4 THEN 'MPN_MISSING' ELSE 'MALFORMED' END AS outcome,
  CASE WHEN p_partkey % 6 = 1 AND p_partkey <> 1 THEN 'vendor_mpn_mismatch' END AS detail FROM part""",
    "quote_sections": f"{_SECTIONS} SELECT * FROM quoted",
    "public_sections": f"{_SECTIONS} SELECT run_id, section, count(*) AS rows FROM quoted WHERE section_ord > 0 GROUP BY run_id, section",
    "projected_rates": "SELECT 'EUR' AS base_currency, * FROM (VALUES ('USD', CAST(1.0825 AS DECIMAL(12,6))), ('GBP', CAST(0.85613 AS DECIMAL(12,6)))) AS t(currency_code, rate)",
    "evidence_quality": f"""WITH e AS ({EVIDENCE.replace('array(', 'list_value(')})
SELECT p_partkey, CASE WHEN from_context AND NOT list_has_any(provenances, ['MANUFACTURER_PRODUCT_CONTEXT', 'MANUFACTURER_RELATION_AUTHORITY']) THEN 'UNSUPPORTED'
  WHEN titled AND len(dimensions) >= 2 AND len(list_distinct(dimensions)) >= 2 THEN 'STRONG' WHEN titled OR len(dimensions) > 0 OR list_has_any(provenances, ['MANUFACTURER_PRODUCT_CONTEXT', 'MANUFACTURER_RELATION_AUTHORITY']) THEN 'LIMITED' ELSE 'WEAK' END AS quality FROM e""",
    "resolution_bounds": f"""{_STATE_SQL} SELECT substate, signal, CASE WHEN substate = 'U1_TITLE_MPN' THEN CASE WHEN listing_ord % 2 = 0 THEN 'DESCRIPTION' ELSE 'PART_NUMBER' END
  WHEN starts_with(substate, 'U5') THEN CASE WHEN url_ord % 13 = 0 THEN 'PART_NUMBER' ELSE 'NONE' END WHEN starts_with(substate, 'V_') OR signal = 'SKU_EQUALS_TARGET' THEN 'PART_NUMBER'
  WHEN substate = 'U3_PARTIAL_BOUNDARY' THEN 'FAMILY_DESCRIPTION' WHEN signal = 'SKU_NOT_TARGET' OR substate = 'U4_NO_MPN' THEN 'DESCRIPTION' ELSE 'NONE' END AS bound, count(*) AS listings FROM state GROUP BY ALL""",
    "bound_reviews": f"""{ASSESS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY url_ord, listing_ord) - 1 AS assessment_index FROM assessed)
SELECT run_id, assessment_index, url_ord, listing_ord, 'CONFIRMED' AS review_state FROM numbered WHERE reviewable AND listing_ord % 2 = 0 AND url_ord % 5 <> 0""",
    "scored_cases": f"""WITH c AS (SELECT case_id FROM ({CASES})), r AS (SELECT CASE WHEN case_id % 10 = 3 THEN -case_id ELSE case_id END AS case_id FROM c)
SELECT CASE WHEN c.case_id IS NULL THEN 'UNKNOWN_CASE' WHEN r.case_id IS NULL THEN 'MISSING' ELSE 'ANSWERED' END AS status, count(*) AS cases FROM c FULL JOIN (SELECT * FROM r WHERE case_id % 7 <> 0) r ON c.case_id = r.case_id GROUP BY 1""",
    "run_decisions": f"""WITH m AS ({_METRICS}), n AS (SELECT *, CAST(substr(run_id, 4) AS INTEGER) AS k, CASE WHEN v > 0 THEN round(hit / v, 6) ELSE 0.0 END AS accuracy FROM m)
SELECT run_id, CASE WHEN false_matches >= 3 THEN 'NOT_QUALIFIED' WHEN k % 5 = 0 THEN 'POLICY_PENDING' WHEN cases < 2 THEN 'INCOMPLETE_COVERAGE' WHEN k % 3 = 0 THEN 'THRESHOLD_INDETERMINATE' WHEN accuracy < 0.5 THEN 'BELOW_THRESHOLD' ELSE 'QUALIFIED' END AS decision FROM n""",
    "streamed_events": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "repeated_events": "SELECT user_id, event_type, event_id % 3 AS part, count(*) AS count FROM events GROUP BY ALL HAVING count(*) > 1",
}
