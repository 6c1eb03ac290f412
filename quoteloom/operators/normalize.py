"""Raw listings to amounts, currencies and closed vocabularies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions import commerce, price
from quoteloom.functions.text import collapsed


def normalize_listings(listings: DataFrame) -> DataFrame:
    """Adds price_amount, currency_code, availability, condition, seller_name and issues (an array
    in the order price, currency, conflict, availability, condition). Raw columns stay."""
    c = F.col
    rows = price.with_price(listings, "price_text").withColumn("_stated", price.currency(c("currency_text")))
    # fields are taken out once: a field of a struct is otherwise written out at each use
    rows = rows.withColumns({"_amount": c("_price.amount"), "_embedded": c("_price.currency"), "_issue": c("_price.issue")})
    embedded = c("_embedded")
    rows = rows.withColumns({"availability": commerce.availability(c("availability_text")), "condition": commerce.condition(c("condition_text"))})
    issues = F.array_compact(
        F.array(
            c("_issue"),
            F.when(c("currency_text").isNotNull() & c("_stated").isNull(), "UNRECOGNIZED_CURRENCY"),
            F.when(c("_stated").isNotNull() & embedded.isNotNull() & (c("_stated") != embedded), "CONFLICTING_CURRENCY"),
            F.when(c("availability_text").isNotNull() & (c("availability") == "UNKNOWN"), "UNRECOGNIZED_AVAILABILITY"),
            F.when(c("condition_text").isNotNull() & (c("condition") == "UNKNOWN"), "UNRECOGNIZED_CONDITION"),
        )
    )
    rows = rows.withColumns({"price_amount": c("_amount"), "currency_code": price.reconciled(c("_stated"), embedded), "seller_name": collapsed(c("seller_text")), "issues": issues})
    return rows.drop("_price", "_stated", "_amount", "_embedded", "_issue")


def only(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows`` for which ``condition`` holds, tested where the columns are already computed.

    A plain filter on columns derived in many steps is pushed below all of them, and each step's
    expression is then written out inside it again; the row number keeps it above.
    """
    return rows.withColumn("_row", F.monotonically_increasing_id()).where(condition & (F.col("_row") >= 0)).drop("_row")
