"""Queries over the contents of bundles, from texts made of the parts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.operators import bundles
from quoteloom.sources.adapters import view

_BOX = "lower(p_type) || ' + ' || CAST(1 + p_size % 3 AS STRING) || 'x cable'"
_TURNED = "CAST(1 + p_size % 3 AS STRING) || ' Cable & ' || p_type"
#: What a listing and its target publish. Contents, how they are ended, and how they are wrapped go by different columns.
TEXTS = f"""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 END AS unit_quantity, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 3 END AS target_quantity,
  CASE p_partkey % 7 WHEN 6 THEN 'SINGLE_UNIT' ELSE 'BUNDLE' END AS target_kind, CASE WHEN p_partkey % 5 = 0 THEN 'TARGET' END AS attested_side,
  CASE p_partkey % 4 WHEN 0 THEN 'bundle: ' WHEN 1 THEN 'Bundle of 2 (' WHEN 2 THEN '3-unit bundle: ' ELSE '' END || CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN {_TURNED} WHEN 2 THEN {_BOX} || ' (new)' WHEN 3 THEN {_BOX} || ' + bag' ELSE {_BOX} END
    || CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN ', etc.' WHEN 2 THEN ' and more' ELSE ', complete list' END || CASE WHEN p_partkey % 4 = 1 AND p_partkey % 9 <> 0 THEN ')' ELSE '' END AS published,
  {_BOX} || CASE WHEN p_partkey % 8 = 0 THEN '' ELSE '; full contents' END AS wanted
FROM part
"""


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bundles.composition(view(spark, sf_dir, TEXTS, part="p_partkey"), "published", "composition")
    return bundles.composition(rows, "wanted", "target_composition").withColumn("unit_kind", F.lit("BUNDLE"))


def bundle_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir)
    listed = F.array_join(F.transform(bundles.items(F.col("composition.clause")), lambda e: F.concat_ws(" ", e["quantity"].cast("string"), e["item"])), "|")
    return rows.select("p_partkey", "composition.*", listed.alias("items"))


def bundle_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.unit_authority(_read(spark, sf_dir)).select("p_partkey", "relation", "quantity_axis", "unit_authority")


def bundle_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by the tier that each version of the rules gives them."""
    rows = bundles.unit_authority(_read(spark, sf_dir)).withColumn("tier", F.when(F.col("p_partkey") % 2 == 0, "AI_ASSISTED_COMPARABLE").otherwise("MACHINE_VERIFIED"))
    rows = rows.withColumn("contract", F.explode(F.array(*map(F.lit, (*bundles.CONTRACTS, "UNKNOWN")))))
    return bundles.contract_tier(rows).groupBy("contract", "contract_tier").agg(F.count("*").alias("listings"))


QUERIES = {f.__name__: f for f in (bundle_compositions, bundle_units, bundle_tiers)}


def _composition_sql(text: str, name: str) -> str:
    """Clause, state and statement by cutting the text from both ends."""
    return f"""{name}_cut AS (
  SELECT p_partkey, trim({text}) AS whole, regexp_extract(trim({text}), '(?i)^(bundle( of \\d+)?|\\d+-unit bundle)', 1) AS head FROM texts
), {name}_inner AS (
  SELECT p_partkey, CASE WHEN head = '' THEN whole ELSE trim(substr(whole, length(head) + 1)) END AS rest, head FROM {name}_cut
), {name}_clause AS (
  SELECT p_partkey, head <> '' AND starts_with(rest, '(') AND NOT ends_with(rest, ')') AS cut_off,
    nullif(CASE WHEN head = '' THEN rest WHEN starts_with(rest, '(') THEN trim(CASE WHEN ends_with(rest, ')') THEN rest[2:-2] ELSE substr(rest, 2) END) ELSE trim(substr(rest, 2)) END, '') AS c FROM {name}_inner
), {name}_said AS (
  SELECT *, CASE WHEN ends_with(c, ', complete list') THEN ', complete list' WHEN ends_with(c, '; full contents') THEN '; full contents' END AS s FROM {name}_clause
), {name} AS (
  SELECT p_partkey, CASE WHEN state = 'ESTABLISHED' THEN left(c, length(c) - length(s)) WHEN state <> 'ABSENT' THEN c END AS clause, state, CASE WHEN state = 'ESTABLISHED' THEN s END AS statement
  FROM (SELECT *, CASE WHEN c IS NULL THEN 'ABSENT' WHEN cut_off OR ends_with(c, 'etc.') OR ends_with(c, 'and more') THEN 'PARTIAL' WHEN s IS NOT NULL AND length(s) < length(c) THEN 'ESTABLISHED' WHEN s IS NOT NULL THEN 'PARTIAL' ELSE 'SYNTACTICALLY_VALID' END AS state FROM {name}_said)
)"""


def _items_sql(clause: str) -> str:
    """Sorted "quantity item" texts, or null if any entry is of another form."""
    parts = f"regexp_split_to_array({clause}, ' *([+&,]|\\band\\b) *')"
    read = f"list_transform({parts}, lambda e: CASE WHEN regexp_matches(e, '^\\d+[x ]') THEN regexp_extract(e, '^\\d+') || ' ' || regexp_replace(e, '^\\d+[x ] ?', '') ELSE '1 ' || e END)"
    odd = f"list_filter({parts}, lambda e: NOT regexp_full_match(e, '[0-9A-Za-z]([0-9A-Za-z ._-]*[0-9A-Za-z])?'))"
    return f"CASE WHEN {clause} IS NOT NULL AND len({odd}) = 0 THEN list_sort(list_transform({read}, lambda e: lower(e))) END"


_JUDGED = f"""WITH texts AS ({TEXTS}), {_composition_sql("published", "own")}, {_composition_sql("wanted", "other")}, paired AS (
  SELECT texts.*, own.clause, own.state, own.statement, other.clause AS wanted_clause, other.state AS wanted_state, {_items_sql("own.clause")} AS items, {_items_sql("other.clause")} AS wanted_items
  FROM texts JOIN own USING (p_partkey) JOIN other USING (p_partkey)
), axes AS (
  SELECT *, CASE WHEN clause IS NULL OR wanted_clause IS NULL THEN NULL WHEN clause = wanted_clause OR items = wanted_items THEN 'AGREE' WHEN items IS NOT NULL AND wanted_items IS NOT NULL THEN 'DIFFERENT' ELSE 'UNESTABLISHED' END AS relation,
    CASE WHEN target_kind <> 'BUNDLE' THEN NULL WHEN attested_side = 'TARGET' AND NOT (unit_quantity IS NOT NULL AND target_quantity IS NULL) THEN 'REFUSED' WHEN unit_quantity = target_quantity THEN 'CONSISTENT' WHEN unit_quantity <> target_quantity THEN 'CONTRADICTED'
      WHEN unit_quantity IS NULL AND target_quantity IS NULL THEN 'BOTH_UNPUBLISHED' WHEN attested_side IS NOT NULL THEN 'ATTESTED_NOT_MATERIAL' ELSE 'UNDETERMINED' END AS quantity_axis
  FROM paired
), units AS (
  SELECT *, CASE WHEN target_kind <> 'BUNDLE' THEN 'CONTRADICTED' WHEN quantity_axis = 'REFUSED' THEN 'REFUSED' WHEN state IN ('ABSENT', 'PARTIAL') OR wanted_state IN ('ABSENT', 'PARTIAL') THEN 'UNPROVEN'
    WHEN relation = 'AGREE' AND quantity_axis = 'CONTRADICTED' THEN 'CONTRADICTED' WHEN state <> 'ESTABLISHED' OR wanted_state <> 'ESTABLISHED' THEN 'UNPROVEN' WHEN relation = 'DIFFERENT' THEN 'CONTRADICTED'
    WHEN relation = 'AGREE' AND quantity_axis <> 'UNDETERMINED' THEN 'PROVEN_EQUIVALENT' ELSE 'UNPROVEN' END AS unit_authority FROM axes
)"""
ORACLES = {
    "bundle_compositions": f"{_JUDGED} SELECT p_partkey, clause, state, statement, array_to_string(items, '|') AS items FROM units",
    "bundle_units": f"{_JUDGED} SELECT p_partkey, relation, quantity_axis, unit_authority FROM units",
    "bundle_tiers": f"""{_JUDGED}, tiered AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'AI_ASSISTED_COMPARABLE' ELSE 'MACHINE_VERIFIED' END AS tier FROM units), versions AS (
  SELECT unnest(['{"', '".join((*bundles.CONTRACTS, "UNKNOWN"))}']) AS contract)
SELECT contract, CASE WHEN contract NOT LIKE '%FU4' OR unit_authority = 'REFUSED' THEN 'REFUSED' WHEN unit_authority <> 'PROVEN_EQUIVALENT' AND tier = 'AI_ASSISTED_COMPARABLE' THEN 'NEEDS_REVIEW' ELSE tier END AS contract_tier, count(*) AS listings
FROM tiered CROSS JOIN versions GROUP BY ALL""",
}
