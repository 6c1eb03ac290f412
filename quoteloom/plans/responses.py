"""Queries over recorded answers, made of the labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.operators import responses
from quoteloom.sources.adapters import view

_N = "CAST(doc_id AS BIGINT)"
_LISTS = f"""'"matched_attributes":[' || CASE {_N} % 6 WHEN 0 THEN '' WHEN 1 THEN '{{"dimension":"CAPACITY","detail":"x"}},{{"detail":"x","dimension":"CAPACITY"}}' WHEN 2 THEN '{{"dimension":"COLOUR","detail":"x"}}' ELSE '{{"dimension":"BRAND","detail":"' || CAST(doc_id AS STRING) || '"}}' END
  || '],"conflicting_attributes":[],"missing_critical_attributes":[' || CASE {_N} % 4 WHEN 0 THEN '"INTERFACE"' WHEN 1 THEN '"BRAND","BUNDLE"' ELSE '' END || ']'"""
#: Answers whose decision, reason, lists and shape go by different remainders.
ANSWERS = f"""
SELECT doc_id, CASE {_N} % 13 WHEN 5 THEN '```json' WHEN 6 THEN 'So: ' ELSE ' ' END
  || '{{"decision":"' || CASE WHEN toxic = 1 THEN 'NO_MATCH' WHEN quality = 1 THEN 'MATCH' ELSE 'UNCERTAIN' END || '","confidence":' || CASE {_N} % 5 WHEN 0 THEN '"HIGH"' WHEN 1 THEN '"high"' ELSE '"LOW"' END || ',"reason_code":"'
  || CASE {_N} % 7 WHEN 0 THEN 'NO_MATCH_CAPACITY' WHEN 1 THEN 'NO_MATCH_MULTIPLE_CONFLICTS' WHEN 2 THEN 'UNCERTAIN_MISSING_CRITICAL_ATTRIBUTES' WHEN 3 THEN 'NO_MATCH_OTHER' WHEN 4 THEN 'MATCH_EXACT_PRODUCT_CONTEXT' WHEN 5 THEN 'MATCH_DESCRIPTION_AND_ATTRIBUTES' ELSE 'UNCERTAIN_IDENTIFIER_RELATION' END || '",'
  || {_LISTS} || ',"conflict_classes":[' || CASE {_N} % 3 WHEN 0 THEN '"CAPACITY"' WHEN 1 THEN '"CAPACITY","BUNDLE"' ELSE '' END || ']' || CASE WHEN {_N} % 17 = 0 THEN ',"notes":""' ELSE '' END || '}}' || CASE WHEN {_N} % 19 = 0 THEN '}}' ELSE '' END AS raw
FROM labels
"""


def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.parsed_v2(view(spark, sf_dir, ANSWERS))
    return rows.select("doc_id", "problem", "decision", "reason_code", F.size("matched_attributes").alias("matched"), F.array_join("conflict_classes", ",").alias("classes"))


def answer_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many answers each contract refuses, and why."""
    rows = view(spark, sf_dir, ANSWERS)
    one = responses.parsed_v1(rows.withColumn("raw", F.regexp_replace("raw", ',"conflict_classes":\\[[^\\]]*\\]', ""))).select(F.lit(1).alias("contract"), "problem")
    return one.unionByName(responses.parsed_v2(rows).select(F.lit(2).alias("contract"), "problem")).groupBy("contract", "problem").agg(F.count("*").alias("answers"))


QUERIES = {f.__name__: f for f in (judged_answers, answer_problems)}

_READ = f"""WITH answer AS ({ANSWERS}), shaped AS (
  SELECT doc_id, trim(raw) AS t, TRY_CAST(trim(raw) AS JSON) AS j FROM answer
), rule AS (
  SELECT * FROM (VALUES {", ".join(f"('{c}', '{d}', {'NULL' if k is None else repr(k)}, {h}, {str(m).lower()}, {str(a).lower()})" for c, d, k, h, m, a in responses.REASONS)}) AS r(code, rule_decision, class, hard, wants_missing, wants_any)
), field AS (
  SELECT doc_id, t, j, json_extract_string(j, '$.decision') AS decision, json_extract_string(j, '$.confidence') AS confidence, json_extract_string(j, '$.reason_code') AS reason_code, json_extract(j, '$.matched_attributes') AS matched,
    coalesce(json_extract_string(j, '$.missing_critical_attributes[*]'), []) AS missing, coalesce(json_extract_string(j, '$.conflict_classes[*]'), []) AS classes FROM shaped
), checked AS (
  SELECT *, CASE WHEN starts_with(t, '```') THEN 'CODE_FENCE' WHEN NOT (starts_with(t, '{{') AND ends_with(t, '}}')) THEN 'NOT_AN_OBJECT' WHEN j IS NULL THEN 'INVALID_JSON' WHEN json_exists(j, '$.notes') THEN 'UNKNOWN_KEYS'
    WHEN confidence NOT IN ('HIGH', 'MEDIUM', 'LOW') THEN 'BAD_CONFIDENCE' END AS early,
    CASE WHEN len(list_distinct(json_extract_string(matched, '$[*].dimension'))) < json_array_length(matched) OR list_contains(json_extract_string(matched, '$[*].dimension'), 'COLOUR') THEN 'BAD_MATCHED_ATTRIBUTES' END AS lists
  FROM field
), judged AS (
  SELECT *, coalesce(early, lists, CASE WHEN rule_decision <> decision THEN 'REASON_OF_ANOTHER_DECISION' WHEN class IS NOT NULL AND NOT list_contains(classes, class) THEN 'REASON_WITHOUT_ITS_CONFLICT' WHEN len(classes) < hard THEN 'TOO_FEW_HARD_CONFLICTS'
    WHEN wants_missing AND len(missing) = 0 THEN 'NOTHING_MISSING' WHEN wants_any AND len(classes) = 0 THEN 'NO_CONFLICT' WHEN decision <> 'NO_MATCH' AND len(classes) > 0 THEN 'HARD_CONFLICT_HIDDEN' END) AS problem
  FROM checked LEFT JOIN rule ON reason_code = code
)"""
ORACLES = {
    "judged_answers": f"""{_READ} SELECT doc_id, problem, CASE WHEN problem IS NULL THEN decision END AS decision, CASE WHEN problem IS NULL THEN reason_code END AS reason_code, CASE WHEN problem IS NULL THEN json_array_length(matched) END AS matched,
  CASE WHEN problem IS NULL THEN array_to_string(classes, ',') END AS classes FROM judged""",
    "answer_problems": f"""{_READ} SELECT 1 AS contract, coalesce(early, CASE WHEN json_array_length(matched) > 0 THEN 'BAD_MATCHED_ATTRIBUTES' END) AS problem, count(*) AS answers FROM checked GROUP BY ALL
UNION ALL SELECT 2, problem, count(*) FROM judged GROUP BY ALL""",
}
