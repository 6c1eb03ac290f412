"""Queries over price results as payloads: their bytes, the way back, and payloads that were changed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.operators import payloads
from quoteloom.plans.market import ACCEPTED, ASSESS_SQL, assessed


def price_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.encoded(assessed(spark, sf_dir)).select("run_id", "schema_version", F.length("payload").alias("length"), "sha256")


def decoded_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = payloads.decoded(payloads.encoded(assessed(spark, sf_dir)))
    return good.select("run_id", "url_ord", "listing_ord", "source_url", "price_text", "price_amount", "currency_code", "match_type", "decision", F.array_join("issues", ",").alias("issues"))


def replayed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of which some were changed, by run; most with a digest to match."""
    rows = payloads.encoded(assessed(spark, sf_dir))
    text, number = F.col("payload"), F.substring("run_id", 2, 9).cast("long") % 11
    changed = (
        F.when(number == 1, F.concat(F.lit(" "), text))
        .when(number == 2, F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(',"note":1}')))
        .when(number == 3, F.regexp_replace(text, '"verification_status":"[A-Z]+"', '"verification_status":"SURE"'))
        .when(number == 4, F.regexp_replace(text, '"exclusions":\\[.*?\\],"request"', '"exclusions":[{"assessment_index":99999,"reason":"x"}],"request"'))
        .when(number == 5, F.regexp_replace(text, '"buckets":\\[.*\\],"exclusions"', '"buckets":[],"exclusions"'))
        .when(number == 6, F.regexp_replace(text, '"exclusions":\\[.*?\\],"request"', '"exclusions":[],"request"'))
        .otherwise(text)
    )
    rows = rows.withColumn("payload", changed).withColumn("sha256", F.when(number == 7, F.lit("0" * 64)).otherwise(F.sha2("payload", 256)))
    return payloads.replayed(rows.withColumn("schema_version", F.when(number == 8, 2).otherwise(F.col("schema_version"))))


QUERIES = {f.__name__: f for f in (price_payloads, decoded_listings, replayed_payloads)}

_TEXT = lambda n: f"{n} := CAST({n} AS VARCHAR)"
_PAYLOAD = f"""{ASSESS_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY url_ord, listing_ord, source_url, price_text NULLS FIRST, condition_text NULLS FIRST) - 1 AS i, {ACCEPTED} AS reason FROM assessed
), bucket AS (
  SELECT run_id, min(i) AS first, struct_pack(assessment_indexes := list(i ORDER BY i), condition := condition, confidence := CASE WHEN count(*) >= 3 THEN 'MEDIUM' ELSE 'LOW' END, "count" := count(*), currency_code := currency_code,
    high := CAST(max(price_amount) AS VARCHAR), low := CAST(min(price_amount) AS VARCHAR), market_range_high := CASE WHEN count(*) >= 3 THEN CAST(max(price_amount) AS VARCHAR) END, market_range_low := CASE WHEN count(*) >= 3 THEN CAST(min(price_amount) AS VARCHAR) END,
    median := CAST(CAST(median(CAST(price_amount AS DECIMAL(30,12))) AS DECIMAL(38,9)) AS VARCHAR)) AS b FROM numbered WHERE reason IS NULL GROUP BY run_id, currency_code, condition
), listed AS (
  SELECT run_id, list(b ORDER BY first) AS buckets FROM bucket GROUP BY run_id
), payload AS (
  SELECT run_id, to_json(struct_pack(assessments := list(struct_pack(decision := decision, evidence_source := evidence_source, match_type := match_type, normalized_listing := struct_pack(availability := availability, condition := condition, currency_code := currency_code,
      issues := CASE WHEN issues = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(issues, ',') END, observation := struct_pack({", ".join(map(_TEXT, payloads.OBSERVED))}), price_amount := CAST(price_amount AS VARCHAR), seller_name := seller_name),
      place := [url_ord, listing_ord], rejection_reason := rejection_reason) ORDER BY i),
    buckets := coalesce(any_value(buckets), []), exclusions := coalesce(list(struct_pack(assessment_index := i, reason := reason) ORDER BY i) FILTER (reason IS NOT NULL), []), request := struct_pack(description := min(description), requested_mpn := min(requested_mpn)),
    verification_status := CASE coalesce(len(any_value(buckets)), 0) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'VERIFIED' ELSE 'AMBIGUOUS' END)) AS p, coalesce(len(any_value(buckets)), 0) AS n_buckets, count(reason) AS n_excluded
  FROM numbered LEFT JOIN listed USING (run_id) GROUP BY run_id
)"""
ORACLES = {
    "price_payloads": f"{_PAYLOAD} SELECT run_id, 1 AS schema_version, length(CAST(p AS VARCHAR)) AS length, sha256(CAST(p AS VARCHAR)) AS sha256 FROM payload",
    "decoded_listings": f"{ASSESS_SQL} SELECT run_id, url_ord, listing_ord, source_url, price_text, price_amount, currency_code, match_type, decision, issues FROM assessed",
    "replayed_payloads": f"""{_PAYLOAD} SELECT run_id, CASE CAST(run_id[2:] AS BIGINT) % 11 WHEN 1 THEN 'NOT_CANONICAL' WHEN 2 THEN 'NOT_CANONICAL' WHEN 3 THEN 'UNKNOWN_WORD' WHEN 4 THEN 'BAD_INDEX' WHEN 5 THEN CASE WHEN n_buckets > 0 THEN 'NOT_DERIVED' ELSE 'REPLAYED' END
  WHEN 6 THEN CASE WHEN n_excluded > 0 THEN 'NOT_DERIVED' ELSE 'REPLAYED' END WHEN 7 THEN 'DIGEST_MISMATCH' WHEN 8 THEN 'UNSUPPORTED_VERSION' ELSE 'REPLAYED' END AS outcome FROM payload""",
}
