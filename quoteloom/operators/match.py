"""Whether a listing is the requested part."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quoteloom.functions import part_number as pn
from quoteloom.functions.text import strip

SOURCES = ("EXPLICIT_MPN_FIELD", "VISIBLE_LABELED_MPN_FIELD", "SKU_FIELD", "TITLE_TEXT", "NONE")


def assess(rows: DataFrame) -> DataFrame:
    """Adds evidence_source, candidate_text, match_type, decision and rejection_reason.

    The strongest evidence alone counts: a part-number field, else a SKU (even one that differs
    hides the title), else the part number as a token of the title.
    """
    c = F.col
    field = c("mpn_text").isNotNull()
    rows = rows.withColumns({"_asked": strip(c("requested_mpn")), "_named": pn.without_label(c("mpn_text"))})
    rows = rows.withColumns({"_one": pn.key(c("_asked")), "_two": pn.key(c("_named"))})
    blank = F.coalesce(c("_asked") == "", F.lit(True))
    source = (
        F.when(field, F.when(c("extraction_method").endswith("_WITH_VISIBLE_MPN"), "VISIBLE_LABELED_MPN_FIELD").otherwise("EXPLICIT_MPN_FIELD"))
        .when(c("sku_text").isNotNull(), "SKU_FIELD")
        .when(~blank & pn.in_title(c("product_title"), c("requested_mpn")), "TITLE_TEXT")
        .otherwise("NONE")
    )
    empty = F.coalesce((c("_one") == "") | (c("_two") == ""), F.lit(True))
    match = F.when(blank | empty, "UNKNOWN").when(c("_asked") == c("_named"), "EXACT").when(c("_one") == c("_two"), "NORMALIZED_EXACT").when(pn.partial(c("_one"), c("_two")), "PARTIAL").otherwise("UNKNOWN")
    rows = rows.withColumns({"evidence_source": source, "match_type": match})
    reason = (
        F.when(blank, "NO_REQUESTED_MPN")
        .when(~field | (c("_two") == ""), "NO_EXPLICIT_MPN_EVIDENCE")
        .when(c("match_type").isin("EXACT", "NORMALIZED_EXACT"), None)
        .when(c("match_type") == "PARTIAL", "PARTIAL_MPN_ONLY")
        .otherwise("MPN_MISMATCH")
    )
    text = F.when(field, c("mpn_text")).when(c("evidence_source") == "SKU_FIELD", c("sku_text")).when(c("evidence_source") == "TITLE_TEXT", c("requested_mpn")).otherwise("")
    rows = rows.withColumns({"rejection_reason": reason, "candidate_text": text})
    decision = F.when(c("rejection_reason").isNull(), "ACCEPTED").when(c("rejection_reason") == "NO_REQUESTED_MPN", "UNDECIDED").otherwise("REJECTED")
    return rows.withColumn("decision", decision).drop("_asked", "_named", "_one", "_two")


def reviewable() -> Column:
    """Rejected rows that a person may still confirm."""
    c = F.col
    unproven = (c("rejection_reason") == "NO_EXPLICIT_MPN_EVIDENCE") & c("evidence_source").isin("TITLE_TEXT", "SKU_FIELD")
    return F.coalesce((c("decision") == "REJECTED") & ((c("rejection_reason") == "PARTIAL_MPN_ONLY") | unproven), F.lit(False))


def indexed(rows: DataFrame, run: str | list[str], *order: str) -> DataFrame:
    """Adds assessment_index: dense, from 0, within a run."""
    return rows.withColumn("assessment_index", F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1)


def bound_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews joined to the assessment they name; one whose copied fields no longer equal the
    assessment's (null and empty being equal) is left out."""
    r = reviews.select(F.col("run_id"), F.col("assessment_index"), "review_state", "semantic_confidence", "conflicting_attributes", *(F.col(x).alias(f"_r_{x}") for x in ("source_url", "requested_mpn", "product_title", "mpn_text", "sku_text", "evidence_source")))
    joined = rows.join(r, ["run_id", "assessment_index"])
    same = F.lit(True)
    for x in ("source_url", "requested_mpn", "product_title", "mpn_text", "sku_text", "evidence_source"):
        same = same & (F.coalesce(F.col(x), F.lit("")) == F.coalesce(F.col(f"_r_{x}"), F.lit("")))
    return joined.where(reviewable() & same).drop(*(f"_r_{x}" for x in ("source_url", "requested_mpn", "product_title", "mpn_text", "sku_text", "evidence_source")))


# Words that name a conflict of identity.
HARD_TERMS = [
    "mpn", "part number", "manufacturer part number", "model", "suffix", "revision", "capacity", "memory size", "form factor", "interface", "connector",
    "accessory", "compatible with", "replacement", "multipack", "multi pack", "pack size", "pack quantity", "product type", "manufacturer", "brand",
]


def quote_policy(review_state: Column, confidence: Column, strong_sku: Column, conflicts: Column) -> Column:
    """How a candidate enters the working quote; null where the review state is unknown."""
    plain = F.transform(F.coalesce(conflicts, F.array().cast("array<string>")), lambda x: strip(F.regexp_replace(F.translate(F.lower(x), "_-", "  "), "\\s+", " ")))
    hard = F.exists(plain, lambda x: F.exists(F.array(*(F.lit(t) for t in HARD_TERMS)), lambda t: F.contains(x, t)))
    state, level = F.upper(strip(review_state)), F.upper(strip(confidence))
    high = F.when(strong_sku & ~F.exists(plain, lambda x: x != ""), "AUTO_INCLUDE_UNVERIFIED").otherwise("NEEDS_REVIEW")
    open_state = F.when(level == "LOW", "LOW_CONFIDENCE").when(level == "HIGH", high).otherwise("NEEDS_REVIEW")
    return F.when(state == "REJECTED", "REJECTED").when(hard, "HARD_CONFLICT").when(state == "CONFIRMED", "CONFIRMED").when(state == "UNREVIEWED", open_state)


def strong_sku(rows_sku: Column, mpn: Column, evidence_source: Column) -> Column:
    return (evidence_source == "SKU_FIELD") & pn.compare(mpn, rows_sku).isin("EXACT", "NORMALIZED_EXACT")
