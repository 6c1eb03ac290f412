"""A listing view over the driver's tables (synthetic, but deterministic), in SQL that Spark and
DuckDB both run, and the Spark side of running it."""

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LISTINGS = """
SELECT 'r' || CAST(p_partkey AS STRING) AS run_id, 'MZ-' || CAST(p_partkey AS STRING) || 'A' AS requested_mpn,
  p_name || ' ' || p_brand AS description, l_orderkey AS url_ord, l_linenumber AS listing_ord,
  'https://S' || CAST(l_suppkey AS STRING) || '.example/item/' || CAST(l_orderkey AS STRING) AS source_url,
  CASE l_linenumber % 5 WHEN 0 THEN 'JSON_LD_WITH_VISIBLE_MPN' WHEN 4 THEN 'META' ELSE 'JSON_LD' END AS extraction_method,
  CASE WHEN l_orderkey % 6 = 0 THEN p_name || ' MZ-' || CAST(p_partkey AS STRING) || 'A kit' ELSE p_name END AS product_title,
  CASE (l_orderkey + l_linenumber) % 8
    WHEN 0 THEN 'MZ-' || CAST(p_partkey AS STRING) || 'A' WHEN 1 THEN ' mz-' || CAST(p_partkey AS STRING) || 'a '
    WHEN 2 THEN 'MZ-' || CAST(p_partkey AS STRING) || 'A-R' WHEN 3 THEN 'MPN: MZ-' || CAST(p_partkey AS STRING) || 'A'
    WHEN 4 THEN 'MZ-' || CAST(p_partkey AS STRING) || 'B' WHEN 5 THEN 'mz  ' || CAST(p_partkey AS STRING) || 'a' ELSE NULL END AS mpn_text,
  CASE WHEN l_orderkey % 3 = 0 THEN 'X-' || CAST(l_suppkey AS STRING) WHEN l_linenumber % 2 = 0 THEN 'MZ-' || CAST(p_partkey AS STRING) || 'A' ELSE NULL END AS sku_text,
  p_brand AS brand_text,
  CASE l_orderkey % 10
    WHEN 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) WHEN 1 THEN '$' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)
    WHEN 2 THEN 'EUR ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) WHEN 3 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) || ' gbp'
    WHEN 4 THEN 'from ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) WHEN 5 THEN '10 - ' || CAST(l_linenumber AS STRING)
    WHEN 6 THEN 'call us' WHEN 7 THEN NULL WHEN 8 THEN '1,' || CAST(100 + l_linenumber AS STRING) || '.50' ELSE 'EUR 12 USD' END AS price_text,
  CASE l_suppkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN ' eur' WHEN 2 THEN '$' WHEN 3 THEN '£' ELSE NULL END AS currency_text,
  CASE l_linenumber % 6 WHEN 0 THEN 'https://schema.org/InStock' WHEN 1 THEN 'Out of Stock' WHEN 2 THEN 'PreOrder' WHEN 3 THEN 'false' WHEN 4 THEN NULL ELSE 'LimitedAvailability' END AS availability_text,
  CASE l_returnflag WHEN 'N' THEN 'https://schema.org/NewCondition' WHEN 'R' THEN ' used ' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'like new' ELSE 'Refurbished' END END AS condition_text,
  '  Supplier   ' || CAST(l_suppkey AS STRING) || ' ' AS seller_text
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

RATES = """
SELECT * FROM (VALUES ('EUR', 'USD', CAST(1.0825 AS DECIMAL(12,6))), ('EUR', 'GBP', CAST(0.85613 AS DECIMAL(12,6))), ('EUR', 'JPY', CAST(162.31 AS DECIMAL(12,6)))) AS t(base_currency, currency_code, rate)
"""


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by ``keys`` over as many tasks as the cluster runs, for long work on rows of a small
    file: its splits are few, and partitions without a number are joined again because they are small."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


def view(spark: SparkSession, sf_dir: str, sql: str, **deal: str) -> DataFrame:
    """``sql`` over the Parquet tables of ``sf_dir``; a table that ``deal`` names is ``dealt`` by that column
    first, while its rows are short."""
    import re

    used = {t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)}
    literal = sql.replace("{", "{{").replace("}", "}}")  # braces of the text are no fields
    named = re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], literal)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    tables |= {t: dealt(tables[t], key) for t, key in deal.items()}
    return spark.sql(named, **tables) if used else spark.sql(sql)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings, dealt out by run: what follows works on rows and then on runs, so this one exchange
    serves both, and a table of few splits is no bottleneck."""
    return dealt(view(spark, sf_dir, LISTINGS), "run_id")


def rates(spark: SparkSession) -> DataFrame:
    return spark.sql(RATES)
