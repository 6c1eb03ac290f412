"""From an assessed listing and recorded judgements to an authority tier.

The rules are tables: the state's policy, the outcome of a judgement, and what a conflict does.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions import part_number as pn
from quoteloom.functions.text import lookup

# What each identity state allows.
POLICY = {
    "DETERMINISTIC_VERIFIED": ("MACHINE_VERIFIED", False, False),
    "DETERMINISTIC_UNCERTAIN": ("NEEDS_REVIEW", True, True),
    "DETERMINISTIC_CONFLICT": ("HARD_CONFLICT", False, False),
    "DETERMINISTIC_UNEVALUABLE": ("EXCLUDED_LOW_CONFIDENCE", False, False),
}
# Severity of conflicts.
ALWAYS_HARD = ["MPN_IDENTITY", "PRODUCT_FAMILY", "GENERATION", "CAPACITY", "INTERFACE", "FORM_FACTOR", "PRODUCT_ROLE", "ACCESSORY_RELATION", "PACKAGING_QUANTITY", "BUNDLE"]
REVIEWABLE = ["REVISION_OR_SUFFIX", "BRAND", "OTHER_MATERIAL_CONFLICT"]
PRICE_ONLY = ["CONDITION"]
# Signals whose relation to the target must have been reviewed.
NEEDS_RELATION = ["SKU_NOT_TARGET", "PARTIAL_BOUNDARY", "NEAR_MISS_TRUNCATION", "NEAR_MISS_SUBSTITUTION"]
# Badge of each tier.
BADGES = {
    "MACHINE_VERIFIED": "Machine Verified",
    "AI_ASSISTED_COMPARABLE": "AI-Assisted Comparable — not machine verified",
    "NEEDS_REVIEW": "Needs Review — not verified",
    "HUMAN_CONFIRMED": "Human Confirmed",
    "HUMAN_REJECTED": "Human Rejected",
    "HARD_CONFLICT": "Hard Conflict — excluded",
    "EXCLUDED_LOW_CONFIDENCE": "Low Confidence",
    "SEMANTIC_UNAVAILABLE": "AI Evidence Unavailable",
}
ATTENTION = ["NEEDS_REVIEW", "AI_ASSISTED_COMPARABLE", "HUMAN_CONFIRMED", "MACHINE_VERIFIED", "HUMAN_REJECTED", "HARD_CONFLICT", "EXCLUDED_LOW_CONFIDENCE", "SEMANTIC_UNAVAILABLE"]
RELATION_GRANT = "MANUFACTURER_RELATION_AUTHORITY"


def identity_state(rows: DataFrame) -> DataFrame:
    """Adds identity_state, substate and signal to assessed rows."""
    c = F.col
    shape = pn.near_miss(pn.key(c("requested_mpn")), pn.key(pn.without_label(c("mpn_text"))))
    rows = rows.withColumn("_shape", F.when(c("rejection_reason") == "MPN_MISMATCH", shape))
    described = F.coalesce(F.trim("product_title") != "", F.lit(False))
    unproven = c("rejection_reason") == "NO_EXPLICIT_MPN_EVIDENCE"
    found = F.struct
    pick = (
        F.when(c("decision") == "UNDECIDED", found(F.lit("E1_NO_TARGET_MPN").alias("substate"), F.lit("NO_RELATION").alias("signal")))
        .when(c("match_type") == "EXACT", found(F.lit("V_EXACT").alias("substate"), F.lit("EXACT").alias("signal")))
        .when(c("match_type") == "NORMALIZED_EXACT", found(F.lit("V_NORMALIZED_EXACT").alias("substate"), F.lit("NORMALIZED_EXACT").alias("signal")))
        .when(unproven & (c("evidence_source") == "TITLE_TEXT"), found(F.lit("U1_TITLE_MPN").alias("substate"), F.lit("TITLE_MPN_TOKEN").alias("signal")))
        .when(
            unproven & (c("evidence_source") == "SKU_FIELD"),
            found(F.lit("U2_SKU_ONLY").alias("substate"), F.when(pn.compare(c("requested_mpn"), c("sku_text")) == "UNKNOWN", "SKU_NOT_TARGET").otherwise("SKU_EQUALS_TARGET").alias("signal")),
        )
        .when(unproven, found(F.when(described, "U4_NO_MPN").otherwise("E2_NO_CANDIDATE_EVIDENCE").alias("substate"), F.when(c("evidence_source") == "NONE", "NO_RELATION").otherwise("EMPTY_MPN_FIELD").alias("signal")))
        .when(c("rejection_reason") == "PARTIAL_MPN_ONLY", found(F.lit("U3_PARTIAL_BOUNDARY").alias("substate"), F.lit("PARTIAL_BOUNDARY").alias("signal")))
        .when(c("_shape").isNotNull(), found(F.lit("U5_NEAR_MISS_MPN").alias("substate"), F.concat(F.lit("NEAR_MISS_"), c("_shape")).alias("signal")))
        .otherwise(found(F.lit("C1_INCOMPATIBLE_EXPLICIT_MPN").alias("substate"), F.lit("NO_RELATION").alias("signal")))
    )
    rows = rows.withColumn("_pick", pick).withColumns({"substate": c("_pick.substate"), "signal": c("_pick.signal")}).drop("_shape", "_pick")
    first = F.substring("substate", 1, 1)
    state = F.when(first == "V", "DETERMINISTIC_VERIFIED").when(first == "U", "DETERMINISTIC_UNCERTAIN").when(first == "C", "DETERMINISTIC_CONFLICT").otherwise("DETERMINISTIC_UNEVALUABLE")
    return rows.withColumn("identity_state", state)


def _policy(k: int) -> Column:
    out = F.lit(None)
    for state, values in POLICY.items():
        out = F.when(F.col("identity_state") == state, F.lit(values[k])).otherwise(out)
    return out


def outcome_tier(decision: Column, confidence: Column, quality: Column) -> Column:
    """Tier of one judgement by its decision, confidence and the quality of its evidence."""
    match = F.when(confidence == "LOW", "EXCLUDED_LOW_CONFIDENCE").when((confidence == "HIGH") & (quality == "STRONG"), "AI_ASSISTED_COMPARABLE").otherwise("NEEDS_REVIEW")
    unsure = F.when(confidence.isin("HIGH", "MEDIUM") & quality.isin("STRONG", "LIMITED"), "NEEDS_REVIEW").otherwise("EXCLUDED_LOW_CONFIDENCE")
    return F.when(decision == "MATCH", match).when(decision == "UNCERTAIN", unsure).when(decision == "NO_MATCH", "EXCLUDED_LOW_CONFIDENCE")


def authority_tier(rows: DataFrame) -> DataFrame:
    """Adds tier and fired_rules.

    Reads identity_state, substate, signal; evaluation_state (EVALUATED, NOT_EVALUATED,
    RUNTIME_FAILURE), decision_v2, confidence, quality, conflict_classes, provenances and
    human_review (CONFIRMED, REJECTED or null).
    """
    c = F.col
    any_of = lambda names: F.arrays_overlap(F.coalesce("conflict_classes", F.array().cast("array<string>")), F.array(*(F.lit(n) for n in names)))
    related = F.coalesce(F.array_contains("provenances", RELATION_GRANT), F.lit(False))
    rows = rows.withColumns({"_eligible": _policy(1), "_confirmable": _policy(2), "_stated": _policy(0), "_hard": any_of(ALWAYS_HARD), "_soft": any_of(REVIEWABLE), "_related": related})
    judged = c("_eligible") & (c("evaluation_state") == "EVALUATED")
    failed = c("_eligible") & (c("evaluation_state") == "RUNTIME_FAILURE")
    base = F.when(failed, "SEMANTIC_UNAVAILABLE").when(judged, outcome_tier(c("decision_v2"), c("confidence"), c("quality"))).otherwise(c("_stated"))
    rows = rows.withColumn("_base", base)
    is_match = judged & (c("decision_v2") == "MATCH")
    soft, swapped = is_match & c("_soft"), is_match & (c("signal") == "NEAR_MISS_SUBSTITUTION") & ~c("_related")
    rows = rows.withColumns({"_ceiling_soft": soft, "_ceiling_swap": swapped})
    capped = (c("_base") == "AI_ASSISTED_COMPARABLE") & (c("_ceiling_soft") | c("_ceiling_swap"))
    rows = rows.withColumn("_ceiling_relation", (c("_base") == "AI_ASSISTED_COMPARABLE") & ~capped & c("signal").isin(*NEEDS_RELATION) & ~c("_related"))
    machine = F.when(judged & c("_hard"), "HARD_CONFLICT").when(capped | c("_ceiling_relation"), "NEEDS_REVIEW").otherwise(c("_base"))
    rows = rows.withColumn("_machine", machine)
    blocked = (c("_machine") == "HARD_CONFLICT") | ~c("_confirmable")
    reviewed = c("human_review").isNotNull()
    tier = F.when(reviewed & ~blocked, F.when(c("human_review") == "CONFIRMED", "HUMAN_CONFIRMED").otherwise("HUMAN_REJECTED")).otherwise(c("_machine"))
    rules = {
        "STATE_POLICY_DETERMINISTIC": ~c("_eligible") | (c("evaluation_state") == "NOT_EVALUATED"),
        "INELIGIBLE_STATE_IGNORES_SEMANTIC": ~c("_eligible") & (c("evaluation_state") == "EVALUATED"),
        "RUNTIME_FAILURE": failed,
        "SEMANTIC_OUTCOME_MATRIX": judged,
        "CEILING_REVIEWABLE_CONFLICT": c("_ceiling_soft"),
        "CEILING_NEAR_MISS_SUBSTITUTION_WITHOUT_RELATION_AUTHORITY": c("_ceiling_swap"),
        "CEILING_IDENTIFIER_RELATIONSHIP_NOT_ESTABLISHED": c("_ceiling_relation"),
        "HARD_CONFLICT_SUPERSEDES": judged & c("_hard"),
        "HARD_CONFLICT_SUPERSEDES_HUMAN": reviewed & blocked,
        "HUMAN_OUTCOME_NOT_APPLICABLE": reviewed & blocked & (c("_machine") != "HARD_CONFLICT"),
        "HUMAN_CONFIRMED_APPLIED": reviewed & ~blocked & (c("human_review") == "CONFIRMED"),
        "HUMAN_REJECTED_APPLIED": reviewed & ~blocked & (c("human_review") == "REJECTED"),
    }
    fired = F.array_sort(F.array_compact(F.array(*(F.when(v, k) for k, v in rules.items()))))
    return rows.withColumns({"tier": tier, "fired_rules": fired}).drop(*(x for x in rows.columns if x.startswith("_")))


# How far each recorded substate and signal can resolve an identity.
BOUNDS = [
    ("V_EXACT", "EXACT", "PART_NUMBER"), ("V_NORMALIZED_EXACT", "NORMALIZED_EXACT", "PART_NUMBER"), ("U1_TITLE_MPN", "TITLE_MPN_TOKEN", "PART_NUMBER"),
    ("U2_SKU_ONLY", "SKU_EQUALS_TARGET", "PART_NUMBER"), ("U2_SKU_ONLY", "SKU_NOT_TARGET", "DESCRIPTION"), ("U3_PARTIAL_BOUNDARY", "PARTIAL_BOUNDARY", "FAMILY_DESCRIPTION"),
    ("U4_NO_MPN", "NO_RELATION", "DESCRIPTION"), ("U4_NO_MPN", "EMPTY_MPN_FIELD", "DESCRIPTION"), ("U5_NEAR_MISS_MPN", "NEAR_MISS_TRUNCATION", "NONE"), ("U5_NEAR_MISS_MPN", "NEAR_MISS_SUBSTITUTION", "NONE"),
    ("C1_INCOMPATIBLE_EXPLICIT_MPN", "NO_RELATION", "NONE"), ("E1_NO_TARGET_MPN", "NO_RELATION", "NONE"), ("E2_NO_CANDIDATE_EVIDENCE", "NO_RELATION", "NONE"), ("E2_NO_CANDIDATE_EVIDENCE", "EMPTY_MPN_FIELD", "NONE"),
]
# Provenances that ground facts of a product.
GROUNDS = ("MANUFACTURER_PRODUCT_CONTEXT", "MANUFACTURER_RELATION_AUTHORITY")


def resolution_bound(substate: Column, signal: Column, compatible: Column, provenances: Column) -> Column:
    """The most that the recorded evidence can resolve: PART_NUMBER, FAMILY_DESCRIPTION, DESCRIPTION or
    NONE. Wording of compatibility takes a title's part number away; a reviewed relation of the maker
    gives a near miss its part number. What a model said plays no part."""
    table = {f"{s}|{g}": b for s, g, b in BOUNDS}
    base = lookup(F.concat_ws("|", substate, signal), table)
    related = (substate == "U5_NEAR_MISS_MPN") & F.array_contains(provenances, RELATION_GRANT)
    return F.when((substate == "U1_TITLE_MPN") & compatible, "DESCRIPTION").when(related, "PART_NUMBER").otherwise(base)


def evidence_quality(titled: Column, dimensions: Column, provenances: Column, from_context: Column) -> Column:
    """STRONG: a title and two facts or more in two dimensions or more; LIMITED: any of title, facts
    (``dimensions``: the dimension of each) or a reviewed product provenance; else WEAK. Where a fact comes
    from reviewed context (``from_context``) and no provenance grounds facts, the row is UNSUPPORTED."""
    facts = F.coalesce(F.size(dimensions), F.lit(0))
    grounded = F.exists(provenances, lambda p: p.isin(*GROUNDS))
    strong = titled & (facts >= 2) & (F.size(F.array_distinct(dimensions)) >= 2)
    return F.when(from_context & ~grounded, "UNSUPPORTED").when(strong, "STRONG").when(titled | grounded | (facts > 0), "LIMITED").otherwise("WEAK")


def badge(tier: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in BADGES.items() for x in kv)), tier)


def attention(tier: Column) -> Column:
    """Place of a tier in the order of what wants attention, from 1."""
    return F.array_position(F.array(*(F.lit(t) for t in ATTENTION)), tier)


def tier_summary(rows: DataFrame, *groups: str) -> DataFrame:
    """Counts of market evidence, of what may be priced, and of each tier."""
    return rows.groupBy(*groups).agg(
        F.count_if(F.col("tier").isin("MACHINE_VERIFIED", "AI_ASSISTED_COMPARABLE", "HUMAN_CONFIRMED", "NEEDS_REVIEW")).alias("market_evidence"),
        F.count_if(F.col("tier").isin("MACHINE_VERIFIED", "HUMAN_CONFIRMED")).alias("pricing_eligible"),
        *(F.count_if(F.col("tier") == t).alias(t.lower()) for t in ATTENTION),
    )


def sales_unit_authority(kind: Column, quantity: Column, target_kind: Column, target_quantity: Column) -> Column:
    """Whether a candidate's sales unit is the target's (a single unit unless stated); a null kind
    is an unknown one and proves nothing."""
    target = F.coalesce(target_kind, F.lit("SINGLE_UNIT"))
    same = kind == target
    counted = F.when(quantity.isNull() | target_quantity.isNull(), "UNPROVEN").when(quantity == target_quantity, "PROVEN_EQUIVALENT").otherwise("CONTRADICTED")
    pack = F.when(F.coalesce(quantity == target_quantity, F.lit(False)), "PROVEN_EQUIVALENT").otherwise("CONTRADICTED")
    return F.when(kind.isNull(), "UNPROVEN").when(~same, "CONTRADICTED").when(kind == "SINGLE_UNIT", "PROVEN_EQUIVALENT").when(kind == "PACK_QUANTITY", pack).otherwise(counted)


def with_sales_unit(tier: Column, unit: Column) -> Column:
    """A comparable product whose sales unit is not proven wants review."""
    return F.when((tier == "AI_ASSISTED_COMPARABLE") & unit.isin("UNPROVEN", "CONTRADICTED"), "NEEDS_REVIEW").otherwise(tier)
