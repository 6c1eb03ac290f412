"""Queries over vendors' answers, in their two forms, made of the parts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.sources import vendors
from quoteloom.sources.adapters import view

_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING)"
_COUNT = "CAST(p_size % 4 AS STRING)"
_YES = "CASE WHEN p_size % 3 = 0 THEN 'false' ELSE 'true' END"
#: The three sections of each part's answer, as JSON; forms go by the key, stock and price by the part.
SECTIONS = f"""
SELECT CAST(p_partkey AS BIGINT) AS run_id,
  CASE p_partkey % 8
    WHEN 0 THEN '{{"vendorPartNumber":" MZ' || CAST(p_partkey AS STRING) || '","pricing":{{"customerPrice":' || {_PRICE} || ',"retailPrice":1,"currencyCode":"usd"}},"availability":' || {_YES} || ',"Avl_Quantity":' || {_COUNT} || '}}'
    WHEN 1 THEN '{{"vendorPartNumber":"MZ1","customerPrice":"' || {_PRICE} || '","currency":"EUR","quantity":' || {_COUNT} || '}}'
    WHEN 2 THEN '{{"vendorPartNumber":"MZ2","pricing":{{"retailPrice":' || {_PRICE} || ',"currencyCode":"EUR"}},"availability":{{"available":' || {_YES} || ',"Avl_Quantity":' || {_COUNT} || '}}}}'
    WHEN 3 THEN '{{"Not Found":' || {_YES} || '}}'
    WHEN 4 THEN '{{"vendorPartNumber":"MZ4","customerPrice":null,"retailPrice":5,"currency":"USD"}}'
    WHEN 5 THEN '{{"vendorPartNumber":' || {_COUNT} || ',"customerPrice":5,"currency":"USD"}}'
    WHEN 6 THEN '{{"vendorPartNumber":"MZ6","retailPrice":' || {_PRICE} || ',"currency":"GBP","available":' || {_YES} || ',"quantity":' || {_COUNT} || '}}'
    ELSE '{{"vendorPartNumber":" ","pricing":{{"customerPrice":-1,"currencyCode":"USD"}}}}' END AS ingram,
  CASE p_partkey % 5
    WHEN 0 THEN '{{"manufacturerPartNumber":"MZ' || CAST(p_partkey AS STRING) || '","price":' || {_PRICE} || ',"currencyCode":"USD","inventoryStatus":{{"stockStatus":"InStock","Avl_Quantity":' || {_COUNT} || '}}}}'
    WHEN 1 THEN '{{"manufacturerPartNumber":"MZ1","price":' || {_PRICE} || ',"currencyCode":null,"currency":"eur","quantity":' || {_COUNT} || '}}'
    WHEN 2 THEN '{{"manufacturerPartNumber":"MZ2","price":"' || {_PRICE} || '","currency":"USD","stockStatus":"OutOfStock","Avl_Quantity":null,"quantity":' || {_COUNT} || '}}'
    WHEN 3 THEN '{{"manufacturerPartNumber":"MZ3","price":' || {_YES} || ',"currency":"USD"}}'
    ELSE '{{"manufacturerPartNumber":"MZ4","price":2,"currency":"USD","inventoryStatus":{{"Avl_Quantity":' || {_COUNT} || '}}}}' END AS cdw,
  CASE p_partkey % 6
    WHEN 0 THEN '{{"OnlineCheck":{{"Header":{{"CurrencyCode":"EUR","SessionId":"x"}},"Item":{{"ManufacturerItemIdentifier":"MZ0","UnitPriceAmount":"' || {_PRICE} || '","AvailabilityTotal":"' || {_COUNT} || '","Note":"No Returns"}}}}}}'
    WHEN 1 THEN '{{"ManufacturerItemIdentifier":"MZ1","UnitPriceAmount":' || {_PRICE} || ',"CurrencyCode":"EUR","AvailabilityTotal":' || {_COUNT} || '}}'
    WHEN 2 THEN '{{"ManufacturerItemIdentifier":"MZ2","UnitPriceAmount":1,"currency":"USD","AvailabilityTotal":"' || {_COUNT} || '","Note":"item not maintained"}}'
    WHEN 3 THEN '{{"ManufacturerItemIdentifier":null,"UnitPriceAmount":1,"currency":' || {_COUNT} || '}}'
    WHEN 4 THEN '{{"OnlineCheck":{{"Header":{{"CurrencyCode":"EUR"}},"Item":{{"UnitPriceAmount":2}}}}}}'
    ELSE '{{"ManufacturerItemIdentifier":"MZ5","UnitPriceAmount":' || {_PRICE} || ',"currency":"EUR","AvailabilityTotal":"' || {_COUNT} || '"}}' END AS synnex
FROM part
"""
COLUMNS = ("run_id", "source_name", "outcome", "explicit_mpn", "price", "currency_code", "availability", "quantity", "price_basis", "note_kind")


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.concat(F.lit('{"Ingram":'), "ingram", F.lit(',"CDW":'), "cdw", F.lit(',"Synnex EU":'), "synnex", F.lit(',"asked":1}'))
    return view(spark, sf_dir, SECTIONS, part="p_partkey").select("run_id", parts.alias("body"))


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as text: paragraphs with entities for odd keys, else plain lines in a program's notation."""

    def literal(section):
        plain = section
        for one, other in (("true", "True"), ("false", "False"), ("null", "None"), ('"', "'")):
            plain = F.replace(plain, F.lit(one), F.lit(other))
        return F.when(F.col("run_id") % 2 == 1, F.concat(F.replace(section, F.lit('"'), F.lit("&quot;")), F.lit("</p>"))).otherwise(plain)

    opened = F.when(F.col("run_id") % 2 == 1, "<p>").otherwise(" ")
    lines = [x for name, column in (("Ingram", "ingram"), ("CDW", "cdw"), ("Synnex EU", "synnex")) for x in (opened, F.lit(f"{name} Product: "), literal(F.col(column)), F.lit("\nAcme Product: {1}\r\n"))]
    return view(spark, sf_dir, SECTIONS, part="p_partkey").select("run_id", F.concat(*lines).alias("body"))


def vendor_json_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendors.offers(_json(spark, sf_dir)).select(*COLUMNS)


def vendor_text_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendors.offers(_text(spark, sf_dir)).select(*COLUMNS)


def vendor_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendors.lookups(_text(spark, sf_dir))


QUERIES = {f.__name__: f for f in (vendor_json_offers, vendor_text_offers, vendor_lookups)}

# the same rules by DuckDB's functions of JSON
_FIELDS = f"""WITH section AS (
  SELECT run_id, unnest(['Ingram', 'CDW', 'Synnex EU']) AS source_name, CAST(unnest([ingram, cdw, synnex]) AS JSON) AS j FROM ({SECTIONS})
), placed AS (
  SELECT *, CASE source_name WHEN 'Ingram' THEN coalesce(json_type(j, '$.pricing') = 'OBJECT', false) WHEN 'CDW' THEN coalesce(json_type(j, '$.inventoryStatus') = 'OBJECT', false) ELSE json_exists(j, '$.OnlineCheck') END AS nested FROM section
), field AS (
  SELECT run_id, source_name, j, nested,
    CASE source_name WHEN 'Ingram' THEN json_extract(j, '$.vendorPartNumber') WHEN 'CDW' THEN json_extract(j, '$.manufacturerPartNumber') ELSE json_extract(j, CASE WHEN nested THEN '$.OnlineCheck.Item.ManufacturerItemIdentifier' ELSE '$.ManufacturerItemIdentifier' END) END AS mpn,
    CASE source_name WHEN 'Ingram' THEN CASE WHEN json_exists(j, '$.pricing.customerPrice') THEN json_extract(j, '$.pricing.customerPrice') WHEN json_exists(j, '$.customerPrice') THEN json_extract(j, '$.customerPrice') WHEN nested THEN json_extract(j, '$.pricing.retailPrice') ELSE json_extract(j, '$.retailPrice') END
      WHEN 'CDW' THEN json_extract(j, '$.price') ELSE json_extract(j, CASE WHEN nested THEN '$.OnlineCheck.Item.UnitPriceAmount' ELSE '$.UnitPriceAmount' END) END AS cost,
    CASE source_name WHEN 'Ingram' THEN json_extract(j, CASE WHEN nested THEN '$.pricing.currencyCode' ELSE '$.currency' END) WHEN 'CDW' THEN CASE WHEN json_type(j, '$.currencyCode') = 'VARCHAR' THEN json_extract(j, '$.currencyCode') ELSE json_extract(j, '$.currency') END
      ELSE CASE WHEN nested THEN json_extract(j, '$.OnlineCheck.Header.CurrencyCode') WHEN json_exists(j, '$.currency') THEN json_extract(j, '$.currency') ELSE json_extract(j, '$.CurrencyCode') END END AS money,
    CASE source_name WHEN 'Ingram' THEN CASE WHEN json_type(j, '$.availability') = 'OBJECT' THEN json_extract(j, '$.availability.available') WHEN nested THEN json_extract(j, '$.availability') ELSE json_extract(j, '$.available') END END AS flag,
    CASE source_name WHEN 'Ingram' THEN CASE WHEN json_type(j, '$.availability') = 'OBJECT' THEN json_extract(j, '$.availability.Avl_Quantity') WHEN nested THEN json_extract(j, '$.Avl_Quantity') ELSE json_extract(j, '$.quantity') END
      WHEN 'CDW' THEN CASE WHEN nested THEN json_extract(j, '$.inventoryStatus.Avl_Quantity') ELSE json_extract(j, '$.quantity') END ELSE json_extract(j, CASE WHEN nested THEN '$.OnlineCheck.Item.AvailabilityTotal' ELSE '$.AvailabilityTotal' END) END AS number,
    coalesce(json_extract_string(j, '$.inventoryStatus.stockStatus'), json_extract_string(j, '$.stockStatus')) AS word,
    lower(coalesce(json_extract_string(j, '$.OnlineCheck.Item.Note'), json_extract_string(j, '$.Note'), '')) AS said
  FROM placed
), read AS (
  SELECT run_id, source_name, j, nested, word, said, CASE WHEN json_type(mpn) = 'VARCHAR' THEN nullif(trim(json_extract_string(mpn, '$')), '') END AS explicit_mpn, coalesce(json_type(mpn) NOT IN ('VARCHAR', 'NULL'), false) AS odd,
    CASE WHEN json_type(cost) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(json_extract_string(cost, '$') AS DECIMAL(38,10)) END AS price, CASE WHEN json_type(money) = 'VARCHAR' THEN upper(json_extract_string(money, '$')) END AS currency_code,
    CASE WHEN json_type(flag) = 'BOOLEAN' THEN CAST(flag AS BOOLEAN) END AS flag, CASE WHEN json_type(number) = 'UBIGINT' OR (json_type(number) = 'VARCHAR' AND nested AND source_name = 'Synnex EU') THEN TRY_CAST(json_extract_string(number, '$') AS BIGINT) END AS quantity
  FROM field
), judged AS (
  SELECT *, CASE WHEN json_extract_string(j, '$."Not Found"') = 'true' OR said LIKE '%not maintained%' THEN 'NOT_FOUND' WHEN source_name = 'Synnex EU' AND currency_code IS NULL THEN 'MALFORMED_SECTION' WHEN odd THEN 'MALFORMED_SECTION'
    WHEN explicit_mpn IS NULL THEN 'MISSING_EXPLICIT_MPN' WHEN price IS NULL OR price < 0 OR currency_code IS NULL THEN 'MALFORMED_SECTION' ELSE 'OK' END AS outcome,
    CASE WHEN word = 'InStock' THEN CASE WHEN quantity = 0 THEN 'UNKNOWN' ELSE 'IN_STOCK' END WHEN word = 'OutOfStock' THEN CASE WHEN quantity > 0 THEN 'UNKNOWN' ELSE 'OUT_OF_STOCK' END
      WHEN flag THEN CASE WHEN quantity = 0 THEN 'UNKNOWN' ELSE 'IN_STOCK' END WHEN NOT flag THEN CASE WHEN quantity = 0 THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END
      WHEN source_name = 'CDW' AND nested THEN 'UNKNOWN' WHEN quantity > 0 THEN 'IN_STOCK' WHEN quantity = 0 AND NOT (source_name = 'Ingram' AND nested) THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END AS stock,
    CASE WHEN source_name <> 'Ingram' THEN 'LIST_PRICE' WHEN json_exists(j, '$.pricing.customerPrice') OR json_exists(j, '$.customerPrice') THEN 'CUSTOMER_PRICE' ELSE 'RETAIL_PRICE_FALLBACK' END AS basis
  FROM read
)"""
_OK = ", ".join(f"CASE WHEN outcome = 'OK' THEN {value} END AS {name}" for name, value in zip(COLUMNS[3:], ("explicit_mpn", "price", "currency_code", "stock", "quantity", "basis", "CASE WHEN said LIKE '%no return%' THEN 'NO_RETURNS' END"), strict=True))
_OFFERS = f"{_FIELDS} SELECT run_id, source_name, outcome, {_OK} FROM judged"
ORACLES = {
    "vendor_json_offers": _OFFERS,
    "vendor_text_offers": _OFFERS,
    "vendor_lookups": f"""{_FIELDS} SELECT run_id, CASE WHEN bool_and(outcome = 'OK') THEN 'SUCCESS' WHEN bool_or(outcome IN ('OK', 'NOT_FOUND')) THEN 'PARTIAL' ELSE 'FAILED' END AS lookup_status FROM judged GROUP BY run_id""",
}
