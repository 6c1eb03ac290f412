"""Availability, condition and seller text to closed vocabularies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteloom.functions.text import lookup, strip

# Availability spellings.
AVAILABILITY = {
    "instock": "IN_STOCK", "in stock": "IN_STOCK", "instoreonly": "IN_STOCK", "onlineonly": "IN_STOCK",
    "outofstock": "OUT_OF_STOCK", "out of stock": "OUT_OF_STOCK", "soldout": "OUT_OF_STOCK", "sold out": "OUT_OF_STOCK",
    "preorder": "PREORDER", "pre-order": "PREORDER", "pre order": "PREORDER", "presale": "PREORDER",
    "backorder": "BACKORDER", "back-order": "BACKORDER", "back order": "BACKORDER",
    "limitedavailability": "LIMITED", "limited availability": "LIMITED", "discontinued": "DISCONTINUED",
}
# Condition spellings.
CONDITION = {
    "newcondition": "NEW", "new": "NEW", "usedcondition": "USED", "used": "USED", "refurbishedcondition": "REFURBISHED",
    "refurbished": "REFURBISHED", "refurb": "REFURBISHED", "damagedcondition": "DAMAGED", "damaged": "DAMAGED",
}


def _term(text: Column) -> Column:
    """The bare term in small letters, without the vocabulary's address before it."""
    bare = F.lower(strip(text))
    addressed = F.contains(bare, F.lit("schema.org/"))
    return strip(F.when(addressed, F.regexp_replace(bare, "^(https?://)?schema\\.org/", "")).otherwise(bare))


def availability(text: Column) -> Column:
    return F.coalesce(lookup(_term(text), AVAILABILITY), F.lit("UNKNOWN"))


def condition(text: Column) -> Column:
    return F.coalesce(lookup(_term(text), CONDITION), F.lit("UNKNOWN"))


def inventory_label(value: Column) -> Column:
    return F.when(value.isin("IN_STOCK", "LIMITED"), "In Stock").when(value.isin("OUT_OF_STOCK", "PREORDER", "BACKORDER", "DISCONTINUED"), "Out of Stock").otherwise("Unknown")


def inventory_note(value: Column) -> Column:
    return F.when(value == "LIMITED", "Limited").when(value.isin("PREORDER", "BACKORDER", "DISCONTINUED"), value)


def brand_new_label(value: Column) -> Column:
    return F.when(value == "NEW", "Yes").when(value.isin("USED", "REFURBISHED", "DAMAGED"), "No").otherwise("Unknown")
