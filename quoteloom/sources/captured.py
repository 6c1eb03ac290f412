"""Captured payloads (search results, rate documents, vendor answers, requests) to rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions import part_number as pn
from quoteloom.functions.text import blank_to_null

ORGANIC = "struct<organic:array<string>>"


def search_query(mpn: Column, description: Column, aliases: Column | None = None) -> Column:
    """Text to search for: the quoted part number (or any of its aliases) with the description,
    the part number alone, or the description."""
    part, words = blank_to_null(mpn), blank_to_null(description)
    quoted = F.concat(F.lit('"'), part, F.lit('"'))
    if aliases is not None:
        others = F.transform(aliases, lambda a: F.concat(F.lit('"'), a, F.lit('"')))
        quoted = F.when(F.size(aliases) > 0, F.concat(F.lit("("), F.array_join(F.concat(F.array(quoted), others), " OR "), F.lit(")"))).otherwise(quoted)
    return F.when(part.isNotNull() & words.isNotNull(), F.concat(quoted, F.lit(" "), words)).when(part.isNotNull(), quoted if aliases is not None else part).otherwise(words)


def search_results(payloads: DataFrame) -> DataFrame:
    """run_id, position, url, title, snippet and raw of each usable result of ``raw`` payloads.

    A result needs an absolute http(s) link; titles and snippets count only where they are text.
    A payload that is no object, or whose results are no list, fails the read.
    """
    text = lambda name: F.try_variant_get(F.col("_v"), f"$.{name}", "string")
    is_text = lambda name: F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{name}", "variant")) == "STRING"
    whole = F.parse_json("raw")
    kind = F.schema_of_variant(whole)
    listed = F.try_variant_get(whole, "$.organic", "array<variant>")
    bad = ~kind.startswith("OBJECT") | (F.try_variant_get(whole, "$.organic", "variant").isNotNull() & listed.isNull())
    rows = payloads.select("run_id", F.when(bad, F.raise_error(F.lit("search payload without a list of results"))).otherwise(listed).alias("_list"))
    rows = rows.select("run_id", F.posexplode("_list").alias("position", "_v"))
    rows = rows.select("run_id", "position", text("link").alias("url"), F.when(is_text("title"), text("title")).alias("title"), F.when(is_text("snippet"), text("snippet")).alias("snippet"), F.to_json("_v").alias("raw"))
    return rows.where(F.col("url").rlike("(?i)^https?://[^/?#\\s]+"))


def rate_document(documents: DataFrame) -> DataFrame:
    """observation_date, base_currency (EUR), ord (from 0), currency_code and rate_text, rate of each rate
    in central-bank XML (``body``). The first dated cube counts; rates must be positive numbers and
    there must be some, else the read fails."""
    at = lambda what: F.expr(f"xpath(body, \"(//*[local-name()='Cube'][@time])[1]/*[local-name()='Cube']/@{what}\")")
    day = F.expr("xpath_string(body, \"(//*[local-name()='Cube'][@time])[1]/@time\")")
    rows = documents.select(F.to_date(F.nullif(day, F.lit(""))).alias("observation_date"), F.arrays_zip(at("currency").alias("currency_code"), at("rate").alias("rate_text")).alias("_rates"))
    rows = rows.withColumn("_rates", F.when(F.size("_rates") == 0, F.raise_error(F.lit("rate document without rates"))).otherwise(F.col("_rates")))
    rows = rows.select("observation_date", F.lit("EUR").alias("base_currency"), F.posexplode("_rates").alias("ord", "_r")).select("observation_date", "base_currency", "ord", "_r.*").where(F.col("currency_code").rlike("^[A-Z]{3}$"))
    rate = F.col("rate_text").try_cast("decimal(18,6)")
    return rows.withColumn("rate", F.when(rate > 0, rate).otherwise(F.raise_error(F.concat(F.lit("rate is not a positive number: "), F.col("rate_text"))).cast("decimal(18,6)")))


def search_address(base: str, mpn: Column) -> Column:
    """Address of a shop's search for a part number, percent-encoded."""
    encoded = F.url_encode(mpn)  # as of a form: mend the three characters in which it differs
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return F.concat(F.lit(base), encoded)


def catalog_records(documents: DataFrame) -> DataFrame:
    """document_id, row (from 0), part_number, part_name and is_drive of each usable row of catalogs
    (``raw`` JSON with a list ``details``); rows without a part number are skipped, anything else
    that is not of that shape fails the read. A drive has one or more attributes ``is-ssd``, all
    exactly true."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))
    get = lambda v, name, t: F.try_variant_get(v, f"$['{name}']", t)
    broken = lambda why: F.raise_error(F.lit(f"catalog: {why}"))
    listed = get(F.parse_json("raw"), "details", "array<variant>")
    rows = documents.select("document_id", F.posexplode(F.when(listed.isNull(), broken("no list of details")).otherwise(listed)).alias("row", "_v"))
    v = F.col("_v")
    rows = rows.withColumn("_v", F.when(~kind(v).startswith("OBJECT"), broken("a row is no object")).otherwise(v))
    text = lambda name: F.when(kind(get(v, name, "variant")) == "STRING", get(v, name, "string"))
    attributes = get(v, "attr", "array<variant>")
    marks = F.filter(F.coalesce(attributes, F.array().cast("array<variant>")), lambda a: get(a, "id", "string") == "is-ssd")
    true = lambda a: F.coalesce((kind(get(a, "value", "variant")) == "BOOLEAN") & get(a, "value", "boolean"), F.lit(False))
    rows = rows.select("document_id", "row", text("part-number").alias("part_number"), F.coalesce(text("part-name"), F.lit("")).alias("part_name"), ((F.size(marks) > 0) & F.forall(marks, true)).alias("is_drive"))
    return rows.where("part_number <> ''")


def bound_offers(offers: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vendor offers of a run that are the requested part (requests: run_id, requested_mpn), new by the
    vendor's policy, and the issues: every other offer is a mismatch, and failed ones keep their status."""
    joined = offers.join(requests.select("run_id", "requested_mpn"), "run_id")
    match = F.when(F.col("status") == "OK", pn.compare(F.col("requested_mpn"), F.col("explicit_mpn")))
    joined = joined.withColumn("match_type", match)
    good = F.coalesce(F.col("match_type").isin("EXACT", "NORMALIZED_EXACT"), F.lit(False))
    kept = joined.where(good).withColumns({"brand_new": F.lit(True), "brand_new_basis": F.lit("VENDOR_API_POLICY")})
    outcome = F.when(F.col("status") == "OK", "MPN_MISMATCH").otherwise(F.col("status"))
    return kept, joined.where(~good).select("run_id", "source_name", outcome.alias("outcome"), F.when(F.col("status") == "OK", "vendor_mpn_mismatch").alias("detail"))


def stock_flag(flag: Column, quantity: Column) -> Column:
    """Availability from a vendor's flag and quantity; contradictions are UNKNOWN."""
    some, none = F.coalesce(quantity > 0, F.lit(False)), F.coalesce(quantity == 0, F.lit(False))
    return (
        F.when(flag & (quantity.isNull() | some), "IN_STOCK").when(~flag & none, "OUT_OF_STOCK").when(flag.isNull() & some, "IN_STOCK").otherwise("UNKNOWN")
    )


def vendor_offers(answers: DataFrame) -> DataFrame:
    """run_id, source_name, explicit_mpn, price, price_basis, currency, availability, quantity and
    status of vendor answers (``raw`` JSON: vendorPartNumber, customerPrice, retailPrice,
    currencyCode or currency, available, quantity). Numbers are read from text or number."""
    v = lambda name, kind: F.try_variant_get(F.col("_v"), f"$.{name}", kind)
    rows = answers.select("run_id", "source_name", F.try_parse_json("raw").alias("_v"))
    customer, retail = v("customerPrice", "string").try_cast("decimal(38,10)"), v("retailPrice", "string").try_cast("decimal(38,10)")
    quantity = F.when(v("quantity", "int") >= 0, v("quantity", "int"))
    rows = rows.withColumns({"explicit_mpn": blank_to_null(v("vendorPartNumber", "string")), "_customer": customer, "_retail": retail, "quantity": quantity})
    price = F.coalesce("_customer", "_retail")
    status = F.when(F.col("_v").isNull(), "MALFORMED").when(F.coalesce(v("notFound", "boolean"), F.lit(False)), "NOT_FOUND").when(F.col("explicit_mpn").isNull(), "MPN_MISSING").when(price.isNull(), "PRICE_MISSING").otherwise("OK")
    return rows.select(
        "run_id", "source_name", "explicit_mpn", price.alias("price"), F.when(F.col("_customer").isNotNull(), "CUSTOMER_PRICE").when(F.col("_retail").isNotNull(), "RETAIL_PRICE").alias("price_basis"),
        F.coalesce(v("currencyCode", "string"), v("currency", "string")).alias("currency_code"), stock_flag(v("available", "boolean"), F.col("quantity")).alias("availability"), "quantity", status.alias("status"),
    )


def lookup_status(offers: DataFrame) -> DataFrame:
    """SUCCESS, PARTIAL or FAILED of each run's vendor answers."""
    good, bad, absent = F.count_if(F.col("status") == "OK"), F.count_if(F.col("status") != "OK"), F.count_if(F.col("status") == "NOT_FOUND")
    return offers.groupBy("run_id").agg(F.when((good > 0) & (bad == 0), "SUCCESS").when((good > 0) | (absent > 0), "PARTIAL").otherwise("FAILED").alias("lookup_status"))
