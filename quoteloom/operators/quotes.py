"""Quote rows of all sections in one order, and their dollar values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quoteloom.functions import commerce, fx, quote
from quoteloom.operators.normalize import only

SECTIONS = ("VENDOR", "HUMAN_CONFIRMED", "AI_UNREVIEWED", "PUBLIC", "QUOTE_ONLY")


def with_usd(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds usd, usd_available, usd_reason. ``rates`` (one snapshot: base_currency, currency_code,
    rate) has a row a currency; Spark broadcasts it by its measured size."""
    dollars = rates.where("currency_code = 'USD'").select(F.col("rate").alias("_usd_rate"), F.col("base_currency").alias("_base"))
    every = rates.groupBy().agg(F.max("base_currency").alias("_base_any"))
    one = every.join(dollars, F.col("_base") == F.col("_base_any"), "left").select(F.col("_base_any").alias("_base"), "_usd_rate").withColumn("_one", F.lit(1))
    known = rates.select(F.col("currency_code").alias("_code"), F.col("rate").alias("_rate"))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one", "left").join(known, F.col("currency_code") == F.col("_code"), "left")
    rows = rows.withColumn("_fx", fx.usd_equivalent(F.col("price_amount"), F.col("currency_code"), F.col("_base"), F.col("_rate"), F.col("_usd_rate")))
    rows = rows.withColumns({"usd": F.col("_fx.usd"), "usd_available": F.col("_fx.available"), "usd_reason": F.col("_fx.reason")})
    return rows.drop("_one", "_base", "_usd_rate", "_code", "_rate", "_fx")


def rows(listings: DataFrame, section: Column, amount_text: str = "amount_text") -> DataFrame:
    """Display columns of the rows that are in a ``section`` (others, where it is null, are left out);
    price_text keeps the scale of ``amount_text``. All sections are told in one pass."""
    c = F.col
    listings = only(listings.withColumn("_section", section), F.col("_section").isNotNull())
    return listings.select(
        "run_id",
        (F.array_position(F.array(*(F.lit(s) for s in SECTIONS)), c("_section")) - 1).cast("int").alias("section_ord"),
        c("_section").alias("section"),
        quote.source_label(c("source_url")).alias("source"),
        F.when(c("price_amount").isNotNull() & c("currency_code").isNotNull(), quote.price_text(c(amount_text), c("currency_code"))).alias("price_text"),
        "price_amount",
        "currency_code",
        commerce.inventory_label(c("availability")).alias("inventory"),
        commerce.brand_new_label(c("condition")).alias("brand_new"),
        quote.notes(commerce.inventory_note(c("availability")), F.when(c("price_amount") == 0, "Zero price")).alias("note"),
    )


def required_currencies(found: DataFrame, vendor: DataFrame | None = None) -> DataFrame:
    """Currencies whose rates are needed: those of buckets and vendor rows that are not dollars,
    and dollars with them if there is any."""
    used = found.select("currency_code")
    used = used.unionByName(vendor.select("currency_code")) if vendor is not None else used
    other = only(used.distinct(), F.col("currency_code") != "USD")
    return other.unionByName(other.limit(1).select(F.lit("USD").alias("currency_code")))


def with_links(rows: DataFrame, listings: DataFrame) -> DataFrame:
    """``rows`` (run_id, ord, source) with link: the address of the listing (``listings``: run_id, ord,
    source_url) that has the same place in its run. A run's two lists are laid side by side only if they are
    equally long, and a pair counts only if the listing's host is the row's source and its address is safe to
    show; otherwise there is no link."""

    def placed(table: DataFrame, *kept: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("run_id").orderBy("ord")).alias("_place")
        return table.select("run_id", *kept, place, F.count("*").over(Window.partitionBy("run_id")).alias("_many"))

    found = placed(listings, "source_url")
    joined = placed(rows, "ord", "source").join(found, ["run_id", "_place", "_many"], "left")
    url = F.col("source_url")
    same = (quote.source_label(url) == F.col("source")) & quote.safe_link(url)
    return joined.select("run_id", "ord", "source", F.when(same, url).alias("link"))
