"""Queries over identity states, authority tiers, sales units, and captured payloads."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.functions import fx, quote
from quoteloom.operators import authority, extract
from quoteloom.plans.market import ASSESS_SQL, assessed
from quoteloom.sources import captured
from quoteloom.sources.adapters import view

JUDGED = {
    "evaluation_state": "CASE url_ord % 5 WHEN 0 THEN 'NOT_EVALUATED' WHEN 1 THEN 'RUNTIME_FAILURE' ELSE 'EVALUATED' END",
    "decision_v2": "CASE listing_ord % 3 WHEN 0 THEN 'UNCERTAIN' WHEN 1 THEN 'MATCH' ELSE 'NO_MATCH' END",
    "confidence": "CASE url_ord % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END",
    "quality": "CASE url_ord % 4 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'LIMITED' WHEN 2 THEN 'STRONG' ELSE 'WEAK' END",
    "conflict": "CASE url_ord % 11 WHEN 0 THEN 'CAPACITY' WHEN 1 THEN 'BRAND' WHEN 2 THEN 'CONDITION' ELSE NULL END",
    "related": "url_ord % 13 = 0",
    "human_review": "CASE url_ord % 17 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' ELSE NULL END",
}
UNITS = """
SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'drive 10-pack' WHEN 1 THEN 'drive, tray of 20.' WHEN 2 THEN 'drive (tray)' WHEN 3 THEN 'bundle: drive + cable' WHEN 4 THEN 'bundle of 3'
  WHEN 5 THEN 'single unit' WHEN 6 THEN 'pack of 4TB drives' WHEN 7 THEN 'pack' WHEN 8 THEN '5-pack and 6-pack' WHEN 9 THEN 'plain drive' WHEN 10 THEN '10-unit factory pack' ELSE '007 pack' END AS title FROM part
"""
PAYLOADS = """
SELECT 'q' || CAST(p_partkey AS STRING) AS run_id, CASE WHEN p_partkey % 4 = 0 THEN '{"organic":[]}' ELSE '{"organic":[{"link":"https://h' || CAST(p_size AS STRING) || '.example/a","title":"' || p_name || '","position":1},{"link":"ftp://x/y"},{"title":"no link"},{"link":"http://k.example","title":5}]}' END AS raw FROM part
"""
OFFERS = """
SELECT 'r' || CAST(p_partkey AS STRING) AS run_id, 'A' AS source_name, CASE p_partkey % 6 WHEN 0 THEN '{"vendorPartNumber":" MZ' || CAST(p_partkey AS STRING) || '","customerPrice":"12.50","currencyCode":"USD","available":true,"quantity":3}'
  WHEN 1 THEN '{"vendorPartNumber":"MZ1","retailPrice":"9.75","currency":"EUR","available":false,"quantity":0}' WHEN 2 THEN '{"notFound":true}' WHEN 3 THEN '{"vendorPartNumber":"MZ3","available":true,"quantity":0}'
  WHEN 4 THEN '{"customerPrice":"1","quantity":2}' ELSE 'oops' END AS raw FROM part
"""
PAGES = """
SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN '<html><script type="application/ld+json">{"@type":"Product","name":" ' || p_name || ' ","mpn":"MZ' || CAST(p_partkey AS STRING) || '","offers":[{"price":1055.850,"priceCurrency":"USD"},{"price":"7","availability":"InStock"}]}</script></html>'
  WHEN 1 THEN '<html><head><meta property="product:price:amount" content="12.50"><meta property="og:title" content="' || p_name || '"></head></html>' ELSE '<html><p>' || p_name || '</p></html>' END AS html FROM part
"""
# a day's document of a central bank, from what was ordered on it; one currency may come twice
RATE_DAYS = """
SELECT o_orderdate AS day, '1.' || CAST(1000 + CAST(sum(o_custkey) AS BIGINT) % 9000 AS STRING) AS usd, '0.' || CAST(100 + count(*) AS STRING) AS gbp, CAST(100 + CAST(max(o_orderkey) AS BIGINT) % 90 AS STRING) || '.50' AS jpy,
  CASE WHEN count(*) % 4 = 0 THEN '0.5' END AS again FROM (SELECT CAST(o_orderdate AS DATE) AS o_orderdate, o_custkey, o_orderkey FROM orders) o GROUP BY o_orderdate
"""
RATES_XML = f"""
SELECT '<?xml version="1.0"?><Envelope xmlns="urn:x"><Cube><Cube time="' || CAST(day AS STRING) || '"><Cube currency="USD" rate="' || usd || '"/><Cube currency="JPY" rate="' || jpy || '"/><Cube currency="GBP" rate="' || gbp || '"/>'
  || coalesce('<Cube currency="GBP" rate="' || again || '"/>', '') || '</Cube><Cube time="1999-01-04"><Cube currency="USD" rate="9"/></Cube></Cube></Envelope>' AS body FROM ({RATE_DAYS}) d
"""
PROVIDER = 'Bänk "A" \U0001f4b6'


def identity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = authority.identity_state(assessed(spark, sf_dir))
    return rows.groupBy("identity_state", "substate", "signal").agg(F.count("*").alias("listings"))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = authority.identity_state(assessed(spark, sf_dir)).withColumns({k: F.expr(v) for k, v in JUDGED.items()})
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"conflict_classes": F.when(F.col("conflict").isNotNull(), F.array("conflict")).otherwise(none), "provenances": F.when(F.col("related"), F.array(F.lit(authority.RELATION_GRANT))).otherwise(none)})
    return authority.authority_tier(rows)


def authority_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiers(spark, sf_dir).withColumns({"badge": authority.badge(F.col("tier")), "attention": authority.attention(F.col("tier"))})
    return rows.groupBy("tier", "badge", "attention", F.concat_ws(",", "fired_rules").alias("rules")).agg(F.count("*").alias("listings"))


def tier_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority.tier_summary(_tiers(spark, sf_dir), "run_id")


def sales_unit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.sales_units(view(spark, sf_dir, UNITS, part="p_partkey"), "title")
    unit = authority.sales_unit_authority(F.col("unit_kind"), F.col("unit_quantity"), F.lit("PACK_QUANTITY"), F.lit(10))
    return rows.select("p_partkey", "unit_state", "unit_kind", "unit_quantity", unit.alias("unit_authority"))


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured.search_results(view(spark, sf_dir, PAYLOADS)).drop("raw")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'MZ' || CAST(p_partkey AS STRING) END AS mpn, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS description FROM part")
    return rows.select("p_partkey", captured.search_query(F.col("mpn"), F.col("description")).alias("query"))


def vendor_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured.vendor_offers(view(spark, sf_dir, OFFERS))


def vendor_lookup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured.lookup_status(vendor_offers(spark, sf_dir))


def rate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured.rate_document(view(spark, sf_dir, RATES_XML))


def rate_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document holds a few dozen rates
    rows = rate_documents(spark, sf_dir).groupBy("observation_date", "base_currency").agg(F.array_sort(F.collect_list(F.struct("ord", "currency_code", "rate_text"))).alias("rates"))
    return rows.select("observation_date", fx.document_digest(F.lit(f" {PROVIDER}"), F.col("base_currency"), F.col("observation_date"), F.col("rates")).alias("digest"))


def page_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.page_listings(view(spark, sf_dir, PAGES, part="p_partkey"), "page_id")
    return rows.select("page_id", "listing_ord", "extraction_method", "product_title", "mpn_text", "price_text", "currency_text", "availability_text")


def page_extraction_crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawled pages publish no product data: the count must be 0."""
    return extract.page_listings(view(spark, sf_dir, "SELECT page_id, html FROM pages"), "page_id").agg(F.count("*").alias("listings"))


def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT page_id, url FROM pages")
    return rows.select("page_id", quote.source_label(F.col("url")).alias("source"), quote.fetchable(F.col("url")).alias("fetchable"), quote.same_origin(F.col("url"), F.lit("http://ththre.example.com:80/x")).alias("same_origin"))


def routable_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT event_id, CAST(event_id % 256 AS STRING) || '.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 7 AS STRING) || '.1' AS address FROM events")
    return rows.select("event_id", quote.public_ipv4(F.col("address")).alias("public"))


QUERIES = {
    f.__name__: f
    for f in (identity_states, authority_tiers, tier_summaries, sales_unit_states, search_payloads, search_queries, vendor_offers, vendor_lookup_status, rate_documents, rate_digests, page_extraction, page_extraction_crawled, page_addresses, routable_addresses)
}

_STATE_SQL = f"""{ASSESS_SQL}, sub AS MATERIALIZED (
  SELECT *, CASE WHEN decision = 'ACCEPTED' THEN 'V_' || match_type WHEN rejection_reason = 'PARTIAL_MPN_ONLY' THEN 'U3_PARTIAL_BOUNDARY'
      WHEN rejection_reason = 'NO_EXPLICIT_MPN_EVIDENCE' THEN CASE evidence_source WHEN 'TITLE_TEXT' THEN 'U1_TITLE_MPN' WHEN 'SKU_FIELD' THEN 'U2_SKU_ONLY' ELSE 'U4_NO_MPN' END
      WHEN length(one) = length(two) AND hamming(one, two) = 1 THEN 'U5_NEAR_MISS_MPN' WHEN starts_with(one, two) OR starts_with(two, one) THEN 'U5_NEAR_MISS_MPN' ELSE 'C1_INCOMPATIBLE_EXPLICIT_MPN' END AS substate
  FROM assessed
), state AS MATERIALIZED (
  SELECT *, CASE substate WHEN 'V_EXACT' THEN 'EXACT' WHEN 'V_NORMALIZED_EXACT' THEN 'NORMALIZED_EXACT' WHEN 'U3_PARTIAL_BOUNDARY' THEN 'PARTIAL_BOUNDARY' WHEN 'U1_TITLE_MPN' THEN 'TITLE_MPN_TOKEN'
      WHEN 'U2_SKU_ONLY' THEN CASE WHEN sku_text = requested_mpn THEN 'SKU_EQUALS_TARGET' ELSE 'SKU_NOT_TARGET' END
      WHEN 'U5_NEAR_MISS_MPN' THEN CASE WHEN length(one) = length(two) THEN 'NEAR_MISS_SUBSTITUTION' ELSE 'NEAR_MISS_TRUNCATION' END ELSE 'NO_RELATION' END AS signal,
    CASE substate[1] WHEN 'V' THEN 'DETERMINISTIC_VERIFIED' WHEN 'U' THEN 'DETERMINISTIC_UNCERTAIN' ELSE 'DETERMINISTIC_CONFLICT' END AS identity_state
  FROM sub
)"""
_TIER_SQL = f"""{_STATE_SQL}, judged AS MATERIALIZED (
  SELECT *, {', '.join(f'{v} AS {k}' for k, v in JUDGED.items())}, substate[1] = 'U' AS eligible FROM state
), based AS MATERIALIZED (
  SELECT *, eligible AND evaluation_state = 'EVALUATED' AS ev,
    CASE WHEN NOT eligible THEN CASE substate[1] WHEN 'V' THEN 'MACHINE_VERIFIED' ELSE 'HARD_CONFLICT' END WHEN evaluation_state = 'RUNTIME_FAILURE' THEN 'SEMANTIC_UNAVAILABLE' WHEN evaluation_state = 'NOT_EVALUATED' THEN 'NEEDS_REVIEW'
      WHEN decision_v2 = 'NO_MATCH' OR confidence = 'LOW' THEN 'EXCLUDED_LOW_CONFIDENCE' WHEN decision_v2 = 'MATCH' THEN CASE WHEN confidence = 'HIGH' AND quality = 'STRONG' THEN 'AI_ASSISTED_COMPARABLE' ELSE 'NEEDS_REVIEW' END
      WHEN quality = 'WEAK' THEN 'EXCLUDED_LOW_CONFIDENCE' ELSE 'NEEDS_REVIEW' END AS base
  FROM judged
), flagged AS MATERIALIZED (
  SELECT *, ev AND decision_v2 = 'MATCH' AND coalesce(conflict = 'BRAND', false) AS soft, ev AND decision_v2 = 'MATCH' AND signal = 'NEAR_MISS_SUBSTITUTION' AND NOT related AS swap, ev AND coalesce(conflict = 'CAPACITY', false) AS hard FROM based
), linked AS MATERIALIZED (
  SELECT *, base = 'AI_ASSISTED_COMPARABLE' AND NOT soft AND NOT swap AND NOT related AND signal IN ('SKU_NOT_TARGET', 'PARTIAL_BOUNDARY', 'NEAR_MISS_TRUNCATION', 'NEAR_MISS_SUBSTITUTION') AS unrelated FROM flagged
), machine AS MATERIALIZED (
  SELECT *, CASE WHEN hard THEN 'HARD_CONFLICT' WHEN base = 'AI_ASSISTED_COMPARABLE' AND (soft OR swap OR unrelated) THEN 'NEEDS_REVIEW' ELSE base END AS machine FROM linked
), tiered AS MATERIALIZED (
  SELECT *, machine = 'HARD_CONFLICT' OR NOT eligible AS blocked,
    CASE WHEN human_review IS NULL OR machine = 'HARD_CONFLICT' OR NOT eligible THEN machine WHEN human_review = 'CONFIRMED' THEN 'HUMAN_CONFIRMED' ELSE 'HUMAN_REJECTED' END AS tier FROM machine
)"""
_RULES = """array_to_string(list_sort(list_filter([
  CASE WHEN NOT eligible OR evaluation_state = 'NOT_EVALUATED' THEN 'STATE_POLICY_DETERMINISTIC' END, CASE WHEN NOT eligible AND evaluation_state = 'EVALUATED' THEN 'INELIGIBLE_STATE_IGNORES_SEMANTIC' END,
  CASE WHEN eligible AND evaluation_state = 'RUNTIME_FAILURE' THEN 'RUNTIME_FAILURE' END, CASE WHEN ev THEN 'SEMANTIC_OUTCOME_MATRIX' END, CASE WHEN soft THEN 'CEILING_REVIEWABLE_CONFLICT' END,
  CASE WHEN swap THEN 'CEILING_NEAR_MISS_SUBSTITUTION_WITHOUT_RELATION_AUTHORITY' END, CASE WHEN unrelated THEN 'CEILING_IDENTIFIER_RELATIONSHIP_NOT_ESTABLISHED' END, CASE WHEN hard THEN 'HARD_CONFLICT_SUPERSEDES' END,
  CASE WHEN human_review IS NOT NULL AND blocked THEN 'HARD_CONFLICT_SUPERSEDES_HUMAN' END, CASE WHEN human_review IS NOT NULL AND blocked AND machine <> 'HARD_CONFLICT' THEN 'HUMAN_OUTCOME_NOT_APPLICABLE' END,
  CASE WHEN human_review = 'CONFIRMED' AND NOT blocked THEN 'HUMAN_CONFIRMED_APPLIED' END, CASE WHEN human_review = 'REJECTED' AND NOT blocked THEN 'HUMAN_REJECTED_APPLIED' END], lambda x: x IS NOT NULL)), ',')"""
_BADGE = "CASE tier " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in authority.BADGES.items()) + " END"
_ORDER = "CASE tier " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(authority.ATTENTION, 1)) + " END"
_UNIT = {0: ("OBSERVED_UNAMBIGUOUS", "PACK_QUANTITY", 10), 1: ("OBSERVED_UNAMBIGUOUS", "TRAY_OR_FACTORY_PACK", 20), 2: ("OBSERVED_UNAMBIGUOUS", "TRAY_OR_FACTORY_PACK", None), 3: ("OBSERVED_UNAMBIGUOUS", "BUNDLE", None), 4: ("AMBIGUOUS_CUE", None, None), 5: ("OBSERVED_UNAMBIGUOUS", "SINGLE_UNIT", None), 6: ("AMBIGUOUS_CUE", None, None), 7: ("AMBIGUOUS_CUE", None, None), 8: ("CONTRADICTED_CUES", None, None), 9: ("NO_PACKAGING_PUBLISHED", None, None), 10: ("OBSERVED_UNAMBIGUOUS", "TRAY_OR_FACTORY_PACK", 10), 11: ("AMBIGUOUS_CUE", None, None)}
_lit = lambda v: "NULL" if v is None else repr(v)
_UNIT_ROWS = ", ".join(f"({k}, {_lit(s)}, {_lit(kind)}, {_lit(q)})" for k, (s, kind, q) in _UNIT.items())

ORACLES = {
    "identity_states": f"{_STATE_SQL} SELECT identity_state, substate, signal, count(*) AS listings FROM state GROUP BY ALL",
    "authority_tiers": f"{_TIER_SQL} SELECT tier, {_BADGE} AS badge, CAST({_ORDER} AS BIGINT) AS attention, {_RULES} AS rules, count(*) AS listings FROM tiered GROUP BY ALL",
    "tier_summaries": f"""{_TIER_SQL} SELECT run_id, count(*) FILTER (tier IN ('MACHINE_VERIFIED', 'AI_ASSISTED_COMPARABLE', 'HUMAN_CONFIRMED', 'NEEDS_REVIEW')) AS market_evidence, count(*) FILTER (tier IN ('MACHINE_VERIFIED', 'HUMAN_CONFIRMED')) AS pricing_eligible,
  {', '.join(f"count(*) FILTER (tier = '{t}') AS {t.lower()}" for t in authority.ATTENTION)} FROM tiered GROUP BY run_id""",
    "sales_unit_states": f"""SELECT p_partkey, s AS unit_state, k AS unit_kind, CAST(q AS INTEGER) AS unit_quantity, CASE WHEN k IS NULL THEN 'UNPROVEN' WHEN k = 'PACK_QUANTITY' AND q = 10 THEN 'PROVEN_EQUIVALENT' ELSE 'CONTRADICTED' END AS unit_authority
FROM part JOIN (VALUES {_UNIT_ROWS}) AS t(r, s, k, q) ON p_partkey % 12 = r""",
    "search_payloads": """SELECT 'q' || p_partkey AS run_id, 0 AS position, 'https://h' || p_size || '.example/a' AS url, p_name AS title, CAST(NULL AS VARCHAR) AS snippet FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'q' || p_partkey, 3, 'http://k.example', NULL, NULL FROM part WHERE p_partkey % 4 <> 0""",
    "search_queries": """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 THEN '"MZ' || p_partkey || '" ' || p_name WHEN p_partkey % 3 <> 0 THEN 'MZ' || p_partkey WHEN p_partkey % 4 <> 0 THEN p_name END AS query FROM part""",
    "vendor_offers": """SELECT 'r' || p_partkey AS run_id, 'A' AS source_name, CASE p_partkey % 6 WHEN 0 THEN 'MZ' || p_partkey WHEN 1 THEN 'MZ1' WHEN 3 THEN 'MZ3' END AS explicit_mpn, CASE p_partkey % 6 WHEN 0 THEN CAST(12.5 AS DECIMAL(38,10)) WHEN 1 THEN 9.75 WHEN 4 THEN 1 END AS price,
  CASE p_partkey % 6 WHEN 0 THEN 'CUSTOMER_PRICE' WHEN 1 THEN 'RETAIL_PRICE' WHEN 4 THEN 'CUSTOMER_PRICE' END AS price_basis, CASE p_partkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency_code,
  CASE p_partkey % 6 WHEN 0 THEN 'IN_STOCK' WHEN 1 THEN 'OUT_OF_STOCK' WHEN 4 THEN 'IN_STOCK' ELSE 'UNKNOWN' END AS availability, CAST(CASE p_partkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 2 END AS INTEGER) AS quantity,
  CASE p_partkey % 6 WHEN 0 THEN 'OK' WHEN 1 THEN 'OK' WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN 'PRICE_MISSING' WHEN 4 THEN 'MPN_MISSING' ELSE 'MALFORMED' END AS status FROM part""",
    "vendor_lookup_status": "SELECT 'r' || p_partkey AS run_id, CASE WHEN p_partkey % 6 IN (0, 1) THEN 'SUCCESS' WHEN p_partkey % 6 = 2 THEN 'PARTIAL' ELSE 'FAILED' END AS lookup_status FROM part",
    "rate_documents": f"""WITH d AS ({RATE_DAYS}), r AS (SELECT day, unnest([0, 1, 2, 3]) AS ord, unnest(['USD', 'JPY', 'GBP', 'GBP']) AS currency_code, unnest([usd, jpy, gbp, again]) AS rate_text FROM d)
SELECT day AS observation_date, 'EUR' AS base_currency, ord, currency_code, rate_text, CAST(rate_text AS DECIMAL(18,6)) AS rate FROM r WHERE rate_text IS NOT NULL""",
    "rate_digests": f"""SELECT day AS observation_date, sha256('{{"base_currency":"EUR","observation_date":"' || CAST(day AS VARCHAR) || '","provider_id":"B\\u00e4nk \\"A\\" \\ud83d\\udcb6","rates":[["GBP","' || gbp || '"],' || coalesce('["GBP","' || again || '"],', '') || '["JPY","' || jpy || '"],["USD","' || usd || '"]]}}') AS digest FROM ({RATE_DAYS})""",
    "page_extraction": """SELECT p_partkey AS page_id, 0 AS listing_ord, 'JSON_LD' AS extraction_method, ' ' || p_name || ' ' AS product_title, 'MZ' || p_partkey AS mpn_text, '1055.850' AS price_text, 'USD' AS currency_text, NULL AS availability_text FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 1, 'JSON_LD', ' ' || p_name || ' ', 'MZ' || p_partkey, '7', NULL, 'InStock' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 0, 'META', p_name, NULL, '12.50', NULL, NULL FROM part WHERE p_partkey % 3 = 1""",
    "page_extraction_crawled": "SELECT CAST(0 AS BIGINT) AS listings",
    "page_addresses": "SELECT page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS source, true AS fetchable, starts_with(url, 'http://ththre.example.com/') AS same_origin FROM pages",
    "routable_addresses": """WITH x AS (SELECT event_id, event_id % 256 AS a, user_id % 256 AS b, event_id % 7 AS c FROM events)
SELECT event_id, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS public FROM x""",
}
