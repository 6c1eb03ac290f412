"""Queries over support pages made of the parts, and over comparable products found on them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.operators import comparables
from quoteloom.sources import support
from quoteloom.sources.adapters import view

_Q, _B = "chr(39)", "chr(92) || chr(92)"
_P = "CAST(p_partkey AS STRING)"
_FORM = "CASE p_partkey % 4 WHEN 0 THEN '2.5-inch' WHEN 1 THEN 'M.2' WHEN 2 THEN 'e3.s' ELSE 'a brick' END"
#: Pages of support: the part itself, one of another spelling, one of a group, and what is no record.
PAGES = f"""
SELECT p_partkey AS page_id, 'GR-' || CAST(p_partkey % 40 AS STRING) AS target_mpn,
  '<html><script>var otherData = JSON.parse(' || {_Q} || '[{{"skuNumber":"NO"}}]' || {_Q} || ');</script><p>supportSpecsData</p><SCRIPT type="x">' || chr(10) || 'var  supportSpecsData =  JSON.parse(' || {_Q}
  || '[{{"skuNumber":"MZ' || {_P} || '","title":"' || p_name || {_B} || 'u00ae","datasheet":"/d/' || CAST(p_size AS STRING) || '.pdf","features":[{{"title":" Form  Factor","value":" ' || {_FORM} || '"}},{{"title":"Interface","value":"x"}},{{"title":"form factor","value":" "}},{{"title":"form factor","value":7}}]}},'
  || '{{"skuNumber":"mz ' || {_P} || '","title":5,"datasheet":" "}},{{"title":"none"}},{{"skuNumber":" "}},{{"skuNumber":8}},9,'
  || CASE WHEN p_partkey % 5 = 0 THEN '{{"skuNumber":"MZ' || {_P} || '","features":[{{"title":"Form factor","value":"m.2"}}]}}' ELSE '{{"skuNumber":"gr-' || CAST(p_partkey % 40 + p_size % 2 AS STRING) || '","features":[{{"title":"Form Factor","value":"' || {_FORM} || '"}}]}}' END
  || ']' || {_Q} || ');' || chr(10) || 'var supportSpecsData = JSON.parse(' || {_Q} || 'oops' || {_Q} || ');</SCRIPT></html>' AS html
FROM part
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PAGES, part="p_partkey")


def support_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.candidates(support.records(_pages(spark, sf_dir), "page_id"), "page_id").select("page_id", "mpn", "title", "raw_reference")


def support_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = view(spark, sf_dir, "SELECT p_partkey AS product_id, 'MZ' || CAST(p_partkey AS STRING) AS mpn FROM part")
    return support.specifications(support.records(_pages(spark, sf_dir), "page_id"), products, "page_id")


def support_datasheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.datasheet_links(support.records(_pages(spark, sf_dir), "page_id"), "page_id")


def comparable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return comparables.discovered(pages.select("page_id", "html"), pages.select("page_id", "target_mpn"))


def researched_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select("page_id", "html")
    products = view(spark, sf_dir, "SELECT 'MZ' || CAST(p_partkey AS STRING) AS product_id, 'MZ' || CAST(p_partkey AS STRING) AS mpn FROM part")
    return comparables.researched(pages, products).where(F.col("definition_key") == "physical_form_factor").select("product_id", "usable", "state", "value_text")


def comparable_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return comparables.compared(pages.select("page_id", "html"), pages.select("page_id", F.lower("target_mpn").alias("target_mpn")))


QUERIES = {f.__name__: f for f in (support_candidates, support_specs, support_datasheets, comparable_candidates, researched_specs, comparable_similarity)}

_RECORDS = f"""WITH RECURSIVE page AS ({PAGES}), payload AS (
  SELECT page_id, target_mpn, CAST(replace(regexp_extract(html, 'var  supportSpecsData =  JSON.parse\\(''(.*?)''\\);', 1), chr(92) || chr(92), chr(92)) AS JSON) AS j FROM page
), record AS (
  SELECT page_id, target_mpn, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS n, j FROM payload
), named AS (
  SELECT page_id, target_mpn, n, json_extract(j, '$[' || n || ']') AS r, json_extract_string(j, '$[' || n || '].skuNumber') AS sku, 'embedded_json[1][0].record[' || n || ']' AS place FROM record
  WHERE json_type(j, '$[' || n || '].skuNumber') = 'VARCHAR' AND trim(json_extract_string(j, '$[' || n || '].skuNumber')) <> ''
), feature AS (
  SELECT named.*, unnest(range(CAST(json_array_length(r, '$.features') AS BIGINT))) AS f FROM named
), spec AS (
  SELECT page_id, sku, json_extract_string(r, '$.features[' || f || '].value') AS raw_value, place || '.features[' || f || ']' AS raw_reference FROM feature
  WHERE json_type(r, '$.features[' || f || '].value') = 'VARCHAR' AND trim(json_extract_string(r, '$.features[' || f || '].value')) <> '' AND regexp_matches(json_extract_string(r, '$.features[' || f || '].title'), '(?i)^\\s*form\\s+factor\\s*$')
), value AS (
  SELECT sku, CASE lower(trim(raw_value)) WHEN '2.5-inch' THEN '2.5-inch' WHEN 'm.2' THEN 'M.2' WHEN 'e3.s' THEN 'E3.S' END AS form FROM spec
), resolved AS (
  SELECT sku, count(form) AS usable, CASE WHEN count(form) = 0 THEN 'UNKNOWN' WHEN count(DISTINCT form) > 1 THEN 'CONFLICT' ELSE 'VERIFIED' END AS state, CASE WHEN count(DISTINCT form) = 1 THEN min(form) END AS form FROM value GROUP BY sku
), candidate AS (
  SELECT target_mpn, upper(regexp_replace(trim(sku), '\\s+', '-', 'g')) AS mpn_key, arg_min(sku, [page_id, n]) AS mpn, arg_min([CASE WHEN json_type(r, '$.title') = 'VARCHAR' THEN json_extract_string(r, '$.title') END], [page_id, n])[1] AS title,
    min(page_id) AS page_id, arg_min(place, [page_id, n]) AS raw_reference, count(*) AS evidence
  FROM named WHERE upper(regexp_replace(trim(sku), '\\s+', '-', 'g')) <> target_mpn GROUP BY 1, 2
)"""
ORACLES = {
    "support_candidates": f"{_RECORDS} SELECT page_id, sku AS mpn, CASE WHEN json_type(r, '$.title') = 'VARCHAR' THEN json_extract_string(r, '$.title') END AS title, place AS raw_reference FROM named",
    "support_specs": f"{_RECORDS} SELECT page_id, p_partkey AS product_id, 'physical_form_factor' AS definition_key, raw_value, raw_reference FROM spec JOIN part ON sku = 'MZ' || p_partkey",
    "support_datasheets": f"""{_RECORDS} SELECT page_id, sku, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS' WHEN trim(coalesce(max(json_extract_string(r, '$.datasheet')), '')) = '' THEN 'ABSENT' ELSE 'LINK' END AS outcome,
  CASE WHEN count(*) = 1 AND trim(max(json_extract_string(r, '$.datasheet'))) <> '' THEN max(json_extract_string(r, '$.datasheet')) END AS path FROM named GROUP BY page_id, sku""",
    "comparable_candidates": f"{_RECORDS} SELECT target_mpn, mpn_key, mpn, title, page_id, raw_reference, evidence FROM candidate",
    "researched_specs": f"{_RECORDS} SELECT 'MZ' || p_partkey AS product_id, coalesce(usable, 0) AS usable, coalesce(state, 'UNKNOWN') AS state, form AS value_text FROM part LEFT JOIN resolved ON sku = 'MZ' || p_partkey",
    "comparable_similarity": f"""{_RECORDS} SELECT lower(target_mpn) AS target_id, mpn AS candidate_id, CAST(count(a.form || b.form) AS BIGINT) AS scored, round(count(a.form || b.form) / 12, 6) AS coverage,
  max(CASE WHEN a.form = b.form THEN 1.0 WHEN a.form <> b.form THEN 0.0 END) AS observed, round(coalesce(max(CASE WHEN a.form = b.form THEN 1.0 ELSE 0.0 END), 0) / 12, 6) AS evidence_weighted
FROM candidate LEFT JOIN resolved a ON a.sku = lower(target_mpn) LEFT JOIN resolved b ON b.sku = mpn GROUP BY 1, 2""",
}
