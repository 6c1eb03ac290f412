"""Queries over specifications, candidates, judgements and logs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.functions import part_number as pn
from quoteloom.functions.specs import normalize
from quoteloom.operators import evaluation, logs, specs
from quoteloom.operators.pairs import pairs
from quoteloom.operators.rates import asof_latest
from quoteloom.sources.adapters import view

OBSERVATIONS = """
SELECT 'p' || CAST(l_partkey AS STRING) AS product_id,
  CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'capacity' WHEN 1 THEN 'sequential_read' WHEN 2 THEN 'random_read_iops' WHEN 3 THEN 'endurance_dwpd' WHEN 4 THEN 'storage_protocol' WHEN 5 THEN 'pcie_generation' WHEN 6 THEN 'pcie_lane_count' ELSE 'power_loss_protection' END AS definition_key,
  CASE (l_orderkey + l_linenumber) % 8
    WHEN 0 THEN CASE l_orderkey % 7 WHEN 0 THEN '3.84 TB' WHEN 1 THEN '3,840 GB' WHEN 2 THEN '3.84TiB' WHEN 3 THEN 'up to 7 TB' WHEN 4 THEN '1-2 TB' WHEN 5 THEN '3,84 TB' ELSE '0 TB' END
    WHEN 1 THEN CASE l_orderkey % 5 WHEN 0 THEN '6,800 MB/s' WHEN 1 THEN '6.8 GB/s' WHEN 2 THEN '7 GiB/s' WHEN 3 THEN '-5 MB/s' ELSE 'fast' END
    WHEN 2 THEN CASE l_orderkey % 4 WHEN 0 THEN '1,000,000 IOPS' WHEN 1 THEN '1000K IOPS' WHEN 2 THEN '1 M IOPS' ELSE '1000' END
    WHEN 3 THEN CASE l_orderkey % 4 WHEN 0 THEN '1 DWPD' WHEN 1 THEN '1.0' WHEN 2 THEN '3 TBW' ELSE '' END
    WHEN 4 THEN CASE l_orderkey % 3 WHEN 0 THEN 'NVMe' WHEN 1 THEN 'nvme' ELSE 'PCIe NVMe' END
    WHEN 5 THEN CASE l_orderkey % 3 WHEN 0 THEN 'PCIe 4.0' WHEN 1 THEN 'gen4' ELSE 'PCIe' END
    WHEN 6 THEN CASE l_orderkey % 4 WHEN 0 THEN 'x4' WHEN 1 THEN '4 lanes' WHEN 2 THEN '4.5' ELSE '0' END
    ELSE CASE l_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'supported' WHEN 2 THEN 'no' ELSE 'partly' END END AS raw_value,
  CASE WHEN l_suppkey % 3 = 0 THEN 'AUTHORITATIVE' ELSE 'SECONDARY' END AS source_authority
FROM lineitem
"""
OBSERVATION_SQL = f"""WITH obs AS ({OBSERVATIONS}), parts AS (
  SELECT *, CASE definition_key WHEN 'capacity' THEN regexp_extract(raw_value, '(?i)^(-?)([0-9]+(?:,[0-9]+)*(?:\\.[0-9]+)?)\\s*(TB|GB)$', ['s', 'n', 'u'])
      WHEN 'sequential_read' THEN regexp_extract(raw_value, '(?i)^(-?)([0-9]+(?:,[0-9]+)*(?:\\.[0-9]+)?)\\s*(GB/s|MB/s)$', ['s', 'n', 'u'])
      WHEN 'random_read_iops' THEN regexp_extract(raw_value, '^(-?)([0-9]+(?:,[0-9]+)*(?:\\.[0-9]+)?)\\s*([KM]?)\\s*IOPS$', ['s', 'n', 'u'])
      WHEN 'endurance_dwpd' THEN regexp_extract(raw_value, '^(-?)([0-9]+(?:,[0-9]+)*(?:\\.[0-9]+)?)\\s*((?:DWPD)?)$', ['s', 'n', 'u'])
      WHEN 'pcie_lane_count' THEN regexp_extract(raw_value, '^(x?)([0-9]+)(\\s*(?:lanes?)?)$', ['s', 'n', 'u']) END AS g,
    definition_key IN ('capacity', 'sequential_read', 'random_read_iops', 'endurance_dwpd') AS measured
  FROM obs
), valued AS (
  SELECT *, CAST(CAST(replace(nullif(g.n, ''), ',', '') AS DECIMAL(24,6)) * CASE WHEN definition_key = 'pcie_lane_count' THEN 1 WHEN upper(g.u) = 'GB' THEN 0.001 WHEN upper(g.u) IN ('GB/S', 'K') THEN 1000 WHEN g.u = 'M' THEN 1000000 ELSE 1 END AS DECIMAL(38,9)) AS dec,
    CASE definition_key WHEN 'storage_protocol' THEN CASE WHEN lower(raw_value) = 'nvme' THEN 'NVMe' END WHEN 'pcie_generation' THEN CASE WHEN lower(raw_value) IN ('pcie 4.0', 'gen4') THEN 'PCIe 4.0' END
      WHEN 'power_loss_protection' THEN CASE WHEN lower(raw_value) IN ('yes', 'supported') THEN 'true' WHEN lower(raw_value) = 'no' THEN 'false' END END AS txt
  FROM parts
), norm AS (
  SELECT product_id, definition_key, source_authority,
    CASE WHEN raw_value = '' THEN 'MISSING_OR_EMPTY_VALUE' WHEN regexp_matches(raw_value, '\\b(TiB|GiB/s|TBW)\\b') THEN 'UNSUPPORTED_UNIT'
      WHEN measured AND regexp_matches(raw_value, '\\d[\\d,.]*\\s*-\\s*\\d') OR starts_with(raw_value, 'up to') OR raw_value = 'PCIe NVMe' THEN 'AMBIGUOUS_VALUE'
      WHEN measured AND NOT regexp_matches(g.n, '^([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\\.[0-9]+)?$') OR (definition_key = 'pcie_lane_count' AND g.n = '') THEN 'UNRECOGNIZED_FORMAT'
      WHEN (measured OR definition_key = 'pcie_lane_count') AND (g.s = '-' OR dec <= 0) THEN 'OUT_OF_RANGE_OR_NON_POSITIVE'
      WHEN NOT measured AND definition_key <> 'pcie_lane_count' AND txt IS NULL THEN 'UNRECOGNIZED_FORMAT' END AS issue,
    CASE WHEN measured OR definition_key = 'pcie_lane_count' THEN 'DECIMAL' WHEN definition_key = 'power_loss_protection' THEN 'BOOL' ELSE 'TEXT' END AS kind, dec, txt
  FROM valued
), resolved AS (
  SELECT product_id, definition_key, count(*) FILTER (issue IS NULL) AS usable,
    CASE WHEN count(*) FILTER (issue IS NULL) = 0 THEN 'UNKNOWN' WHEN count(DISTINCT coalesce(txt, CAST(dec AS VARCHAR))) FILTER (issue IS NULL) > 1 THEN 'CONFLICT'
      WHEN bool_or(issue IS NULL AND source_authority = 'AUTHORITATIVE') THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS state,
    any_value(kind) AS kind, max(txt) FILTER (issue IS NULL) AS txt, max(dec) FILTER (issue IS NULL) AS dec
  FROM norm GROUP BY product_id, definition_key
), res AS (
  SELECT product_id, definition_key, usable, state, CASE WHEN state IN ('VERIFIED', 'UNVERIFIED') THEN kind END AS value_kind, CASE WHEN state IN ('VERIFIED', 'UNVERIFIED') THEN txt END AS value_text, CASE WHEN state IN ('VERIFIED', 'UNVERIFIED') THEN dec END AS value_dec FROM resolved
)"""
PAIRS = "SELECT 'p' || CAST(p_partkey AS STRING) AS target_id, 'p' || CAST(p_partkey + k AS STRING) AS candidate_id FROM part CROSS JOIN (VALUES (1), (2), (3)) AS t(k)"
CASES = """
SELECT doc_id AS case_id, CASE WHEN toxic = 1 THEN 'MATCH' WHEN quality = 0 THEN 'UNCERTAIN' ELSE 'NON_MATCH' END AS expected,
  CASE WHEN doc_id % 11 = 0 THEN 'UNCERTAIN' WHEN (toxic + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END) % 2 = 1 THEN 'MATCH' ELSE 'NON_MATCH' END AS predicted,
  doc_id % 17 <> 0 AS valid, CASE doc_id % 3 WHEN 0 THEN 'accessory' WHEN 1 THEN 'bundle' ELSE 'plain' END AS case_class, 'run' || CAST(doc_id % 25 AS STRING) AS run_id
FROM labels
"""
LOG = "SELECT user_id AS run_id, event_id, event_type, ts, CASE WHEN event_id % 5 = 0 THEN '' ELSE ' https://h.example/' || CAST(event_id % 40 AS STRING) || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END END AS url FROM events"
REVIEWS = "SELECT user_id AS candidate_id, event_id, CASE event_id % 7 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' WHEN 2 THEN 'undo' WHEN 3 THEN 'remove' WHEN 4 THEN 'confirm' WHEN 5 THEN 'reject' ELSE 'undo' END AS action FROM events"
ATTEMPTS = "SELECT CAST(floor(event_id / 2) AS BIGINT) AS case_id, CASE WHEN event_id % 2 = 0 THEN 'PRIMARY' ELSE 'FALLBACK' END AS role, CASE user_id % 8 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'INVALID_REQUEST_CONFIGURATION' WHEN 3 THEN 'SCHEMA_INVALID' WHEN 4 THEN 'SUCCESS' WHEN 5 THEN 'MODEL_IDENTITY_MISMATCH' WHEN 6 THEN 'SERVER_ERROR' ELSE 'HTTP_ERROR' END AS outcome FROM events"
MISSES = "SELECT a.p_partkey AS part, 'MZ' || CAST(a.p_partkey AS STRING) AS one, 'MZ' || CAST(b.p_partkey AS STRING) AS two FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey"
ASKED = "SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS asked_on FROM orders"
OBSERVED = "SELECT CAST(event_id AS BIGINT) AS observation_id, CAST(o_orderdate AS DATE) AS last_proven_on, CAST(o_orderdate AS DATE) AS observed_on FROM events JOIN orders ON event_id = o_orderkey WHERE event_id % 50 = 0"


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(view(spark, sf_dir, OBSERVATIONS).repartition("product_id"))  # as the resolutions need it


def spec_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    return rows.groupBy("definition_key", "raw_value", "issue", "value_kind", "value_text", "value_dec").agg(F.count("*").alias("observations"))


def spec_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.resolve(_observations(spark, sf_dir))


def spec_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.similarity(spec_resolutions(spark, sf_dir), view(spark, sf_dir, PAIRS))


def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows by part-number key, the first of each kept; the target itself is left out."""
    rows = view(spark, sf_dir, "SELECT p_brand AS target, p_type || '-' || CAST(p_size AS STRING) AS mpn, p_partkey AS ord FROM part").withColumn("mpn_key", pn.key(F.col("mpn")))
    target = rows.sparkSession.createDataFrame([("ECONOMY-11",)], "mpn_key string")
    return specs.representatives(rows.join(target, "mpn_key", "left_anti"), ["target", "mpn_key"], ["ord"]).select("target", "mpn_key", "ord", "group_size")


def datasheet_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of part columns in tables made of parts: three labelled rows, one column a part."""
    cells = view(spark, sf_dir, CELLS)
    parts = cells.where("row = 0 AND col > 0").select(F.col("text").alias("part_number")).distinct()
    return specs.datasheet_values(cells, parts, {"capacity": "capacity", "interface": "interface_connector"})


def judgement_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gates(evaluation.metrics(view(spark, sf_dir, CASES), "case_class"))


def judgement_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = evaluation.gates(evaluation.metrics(view(spark, sf_dir, CASES), "run_id"))
    return evaluation.leaderboard(runs).select("run_id", "gates_passed", "false_matches", "precision_m", "recall_m", "accuracy")


def corpus_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.distribution(view(spark, sf_dir, CASES), "case_class", "expected", "predicted")


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs by case: one lacks every seventh case, the other every fifth."""
    cases = view(spark, sf_dir, CASES)
    second = cases.where("case_id % 5 <> 0").withColumn("predicted", F.when(F.col("case_id") % 9 == 0, "UNCERTAIN").otherwise(F.col("predicted")))
    return evaluation.compared(cases.where("case_id % 7 <> 0"), second)


def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first_urls(view(spark, sf_dir, LOG), "run_id", "url", ["event_id"]).select("run_id", "event_id")


def attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.numbered(view(spark, sf_dir, LOG), "run_id", ["ts", "event_id"]).select("run_id", "event_id", "attempt_number")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest(view(spark, sf_dir, LOG), ["run_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("run_id", "event_type", "event_id")


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.review_events(view(spark, sf_dir, REVIEWS), ["candidate_id"], ["event_id"])


def routed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.routed(view(spark, sf_dir, ATTEMPTS))


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of parts of one size and brand; their number grows with the square of the parts."""
    rows = view(spark, sf_dir, "SELECT p_size, p_brand, p_partkey AS part, 'MZ' || CAST(p_partkey AS STRING) AS mpn FROM part")
    outline = pn.outline(F.col("mpn"))
    met = pairs(rows.withColumns(outline), ["p_size", "p_brand"], ["part"], F.col("one_part") != F.col("two_part"))
    shape = pn.near_miss(F.col("one_mpn"), F.col("two_mpn"), *({k: F.col(f"{side}_{k}") for k in outline} for side in ("one", "two")))
    return met.select(F.col("one_part").alias("part"), F.col("two_mpn").alias("two"), shape.alias("shape"))


def alias_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'M' || CAST(p_partkey AS STRING) WHEN 1 THEN 'M' || CAST(p_partkey AS STRING) || 'R' ELSE 'M' || CAST(p_partkey AS STRING) || 'T' END AS mpn FROM part")
    return rows.select("p_partkey", F.concat_ws(",", pn.alias_family(F.col("mpn"))).alias("family"))


def latest_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_latest(view(spark, sf_dir, ASKED), view(spark, sf_dir, OBSERVED))


CELLS = """
SELECT 'd' || CAST(p_size AS STRING) AS document_id, 1 AS page, CAST(p_partkey AS BIGINT) AS table_index, r AS row, c AS col,
  CASE WHEN c = 0 THEN CASE r WHEN 0 THEN 'Model' WHEN 1 THEN 'Capacity' WHEN 2 THEN 'Interface' ELSE 'Note' END
       WHEN r = 0 THEN 'PN' || CAST(p_partkey % 500 AS STRING) WHEN r = 1 THEN CAST(p_size AS STRING) || ' TB' WHEN r = 2 THEN 'U.2' ELSE 'x' END AS text
FROM part CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(r) CROSS JOIN (VALUES (0), (1)) AS u(c)
"""

QUERIES = {
    f.__name__: f
    for f in (spec_values, spec_resolutions, spec_similarity, candidate_groups, datasheet_lookup, judgement_metrics, judgement_leaderboard, corpus_distribution, run_comparison, url_dedupe, attempt_numbers, latest_events, review_states, routed_attempts, near_misses, alias_families, latest_rates)
}


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round(({a}) / ({b}), 6) ELSE 0.0 END"


_COUNTS = ", ".join(f"count(*) FILTER (valid AND expected = '{e}' AND predicted = '{p}') AS {e[0].lower()}_{p[0].lower()}" for e in evaluation.CLASSES for p in evaluation.CLASSES)


def _metrics_sql(group: str) -> str:
    per = ", ".join(f"{_ratio(f'{x}_{x}', f'm_{x} + n_{x} + u_{x}')} AS precision_{x}, {_ratio(f'{x}_{x}', f'{x}_m + {x}_n + {x}_u')} AS recall_{x}" for x in "mnu")
    return f"""WITH c AS ({CASES}), n AS (SELECT {group}, count(*) AS cases, count(*) FILTER (valid) AS valid_cases, {_COUNTS} FROM c GROUP BY {group}),
m AS (SELECT *, {_ratio("valid_cases", "cases")} AS valid_rate, {_ratio("m_m + n_n + u_u", "valid_cases")} AS accuracy, {per}, n_m + u_m AS false_matches,
  {_ratio("n_m + u_m", "n_m + n_n + n_u + u_m + u_n + u_u")} AS false_match_rate, 10 * (n_m + u_m) + m_n + m_u + n_u + u_n AS safety_cost FROM n),
g AS (SELECT *, false_matches = 0 AS gate_no_false_match, valid_rate >= 0.99 AS gate_valid, precision_m >= 0.98 AS gate_precision, accuracy >= 0.90 AS gate_accuracy FROM m)
SELECT *, gate_no_false_match AND gate_valid AND gate_precision AND gate_accuracy AS gates_passed FROM g"""


ORACLES = {
    "spec_values": f"{OBSERVATION_SQL} SELECT n.definition_key, o.raw_value, n.issue, CASE WHEN n.issue IS NULL THEN n.kind END AS value_kind, CASE WHEN n.issue IS NULL THEN n.txt END AS value_text, CASE WHEN n.issue IS NULL THEN n.dec END AS value_dec, count(*) AS observations FROM (SELECT row_number() OVER () AS i, * FROM norm) n JOIN (SELECT row_number() OVER () AS i, * FROM valued) o USING (i) GROUP BY ALL",
    "spec_resolutions": f"{OBSERVATION_SQL} SELECT * FROM res",
    "spec_similarity": f"""{OBSERVATION_SQL}, pair AS ({PAIRS}), hit AS (
  SELECT p.target_id, p.candidate_id, CASE WHEN t.value_kind = 'DECIMAL' THEN CAST(least(t.value_dec, c.value_dec) AS DOUBLE) / CAST(greatest(t.value_dec, c.value_dec) AS DOUBLE) WHEN t.value_text = c.value_text THEN 1.0 ELSE 0.0 END AS s
  FROM pair p JOIN res t ON t.product_id = p.target_id JOIN res c ON c.product_id = p.candidate_id AND c.definition_key = t.definition_key WHERE t.value_kind IS NOT NULL AND c.value_kind IS NOT NULL
), total AS (SELECT target_id, candidate_id, count(*) AS scored, CAST(sum(CAST(round(s, 9) AS DECIMAL(12,9))) AS DOUBLE) AS total FROM hit GROUP BY 1, 2)
SELECT p.target_id, p.candidate_id, coalesce(scored, 0) AS scored, round(coalesce(scored, 0) / 12, 6) AS coverage, CASE WHEN scored > 0 THEN round(total / scored, 6) END AS observed, round(coalesce(total, 0.0) / 12, 6) AS evidence_weighted FROM pair p LEFT JOIN total USING (target_id, candidate_id)""",
    "candidate_groups": "SELECT p_brand AS target, p_type || '-' || CAST(p_size AS VARCHAR) AS mpn_key, min(p_partkey) AS ord, count(*) AS group_size FROM part WHERE p_type || '-' || CAST(p_size AS VARCHAR) <> 'ECONOMY-11' GROUP BY 1, 2",
    "datasheet_lookup": f"""WITH cell AS ({CELLS}), hit AS (SELECT *, count(*) OVER (PARTITION BY document_id, text) AS n FROM cell WHERE row = 0 AND col > 0)
SELECT h.document_id, h.text AS part_number, CASE l.text WHEN 'Capacity' THEN 'capacity' ELSE 'interface_connector' END AS definition_key, c.text AS raw_value
FROM hit h JOIN cell c USING (document_id, page, table_index, col) JOIN cell l USING (document_id, page, table_index) WHERE n = 1 AND l.col = 0 AND l.row = c.row AND l.text IN ('Capacity', 'Interface')""",
    "judgement_metrics": _metrics_sql("case_class"),
    "judgement_leaderboard": f"SELECT run_id, gates_passed, false_matches, precision_m, recall_m, accuracy FROM ({_metrics_sql('run_id')}) ORDER BY gates_passed DESC, false_matches, precision_m DESC, recall_m DESC, accuracy DESC, run_id LIMIT 20",
    "corpus_distribution": f"WITH c AS ({CASES}) SELECT 'case_class' AS dimension, case_class AS value, count(*) AS cases FROM c GROUP BY 2 UNION ALL SELECT 'expected', expected, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'predicted', predicted, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM c",
    "run_comparison": f"""WITH c AS ({CASES}), a AS (SELECT case_id, predicted AS first FROM c WHERE case_id % 7 <> 0), b AS (SELECT case_id, CASE WHEN case_id % 9 = 0 THEN 'UNCERTAIN' ELSE predicted END AS second FROM c WHERE case_id % 5 <> 0)
SELECT case_id, first, second, CASE WHEN a.first IS NULL THEN 'ONLY_SECOND' WHEN b.second IS NULL THEN 'ONLY_FIRST' WHEN first = second THEN 'SAME' ELSE 'CHANGED' END AS change FROM a FULL JOIN b USING (case_id)""",
    "url_dedupe": f"SELECT run_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, trim(url) ORDER BY event_id) AS k FROM ({LOG})) WHERE k = 1 OR trim(url) = ''",
    "attempt_numbers": f"SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS attempt_number FROM ({LOG})",
    "latest_events": f"SELECT run_id, event_type, event_id FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY run_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "review_states": f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY event_id) AS n FROM ({REVIEWS})), rule AS (
  SELECT * FROM (VALUES ('UNREVIEWED', 'confirm', 'CONFIRMED', 'APPLIED'), ('UNREVIEWED', 'reject', 'REJECTED', 'APPLIED'), ('UNREVIEWED', 'remove', 'REJECTED', 'APPLIED'), ('UNREVIEWED', 'undo', 'UNREVIEWED', 'NO_CHANGE'),
    ('CONFIRMED', 'confirm', 'CONFIRMED', 'NO_CHANGE'), ('CONFIRMED', 'reject', 'CONFIRMED', 'CONFLICT'), ('CONFIRMED', 'remove', 'REJECTED', 'APPLIED'), ('CONFIRMED', 'undo', 'UNREVIEWED', 'APPLIED'),
    ('REJECTED', 'confirm', 'REJECTED', 'CONFLICT'), ('REJECTED', 'reject', 'REJECTED', 'NO_CHANGE'), ('REJECTED', 'remove', 'REJECTED', 'NO_CHANGE'), ('REJECTED', 'undo', 'UNREVIEWED', 'APPLIED')) AS t(state_before, action, state_after, outcome)
), walk AS (
  SELECT e.candidate_id, e.event_id, e.n, e.action, r.state_before, r.outcome, r.state_after FROM e JOIN rule r ON r.state_before = 'UNREVIEWED' AND r.action = e.action WHERE n = 1
  UNION ALL
  SELECT e.candidate_id, e.event_id, e.n, e.action, r.state_before, r.outcome, r.state_after FROM walk w JOIN e ON e.candidate_id = w.candidate_id AND e.n = w.n + 1 JOIN rule r ON r.state_before = w.state_after AND r.action = e.action
) SELECT candidate_id, event_id, action, state_before, outcome, state_after FROM walk""",
    "routed_attempts": f"""WITH w AS (SELECT case_id, max(outcome) FILTER (role = 'PRIMARY') AS "primary", max(outcome) FILTER (role = 'FALLBACK') AS fallback FROM ({ATTEMPTS}) GROUP BY case_id)
SELECT *, CASE WHEN "primary" = 'SUCCESS' THEN 'PRIMARY' WHEN "primary" NOT IN ('SERVER_ERROR', 'INVALID_REQUEST_CONFIGURATION') AND fallback = 'SUCCESS' THEN 'FALLBACK' ELSE 'NONE' END AS answered_by FROM w""",
    "near_misses": f"""SELECT part, two, CASE WHEN length(one) <> length(two) AND (starts_with(one, two) OR starts_with(two, one)) THEN 'TRUNCATION' WHEN length(one) = length(two) AND hamming(one, two) = 1 THEN 'SUBSTITUTION' END AS shape FROM ({MISSES})""",
    "alias_families": "SELECT p_partkey, 'M' || p_partkey || ',M' || p_partkey || 'R,M' || p_partkey || 'T' AS family FROM part",
    "latest_rates": f"""WITH q AS ({ASKED}), o AS (SELECT last_proven_on, max(struct_pack(observed_on, p := last_proven_on, id := observation_id)) AS s FROM ({OBSERVED}) GROUP BY 1), j AS (SELECT q.*, o.s FROM q ASOF LEFT JOIN o ON q.asked_on >= o.last_proven_on)
SELECT request_id, asked_on, s.id AS observation_id, s.observed_on AS observed_on,
  coalesce(s.p = asked_on OR (SELECT bool_and(isodow(s.p + CAST(k AS INTEGER)) >= 6) FROM range(1, asked_on - s.p + 1) AS t(k)), false) AS reusable FROM j""",
}
