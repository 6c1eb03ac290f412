"""Recorded answers of a model, taken at their word or not at all.

An answer counts only if all of it is one JSON object with exactly the keys of its contract, every value
of the kind and vocabulary that the contract names, no list entry twice, and a reason that fits the rest.
Others keep their row with the first thing wrong with them. JSON is read by Spark's parser, which refuses
a key that comes twice; checks are columns in the order in which they are made, and what a reason code asks
for is a table that joins the answers.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.text import strip, whole_json
from quoteloom.operators.authority import ALWAYS_HARD, PRICE_ONLY, REVIEWABLE

# The vocabularies and the keys of both contracts.
DECISIONS, CONFIDENCES = ("MATCH", "NO_MATCH", "UNCERTAIN"), ("HIGH", "MEDIUM", "LOW")
LISTS = ("matched_attributes", "conflicting_attributes", "missing_critical_attributes")
KEYS = {1: ("decision", "confidence", *LISTS, "reason_code"), 2: ("decision", "confidence", *LISTS, "reason_code", "conflict_classes")}
DIMENSIONS = ("PRODUCT_FAMILY", "GENERATION", "CAPACITY", "INTERFACE", "FORM_FACTOR", "PRODUCT_ROLE", "ACCESSORY_RELATION", "PACKAGING_QUANTITY", "BUNDLE", "BRAND", "REVISION_OR_SUFFIX", "CONDITION")
CLASSES = (*ALWAYS_HARD, *REVIEWABLE, *PRICE_ONLY)
# What each reason code goes with (decision, a class of conflict, hard classes at least, missing attributes, any conflict).
REASONS = [
    ("MATCH_EXACT_PRODUCT_CONTEXT", "MATCH", None, 0, False, False), ("MATCH_DESCRIPTION_AND_ATTRIBUTES", "MATCH", None, 0, False, False), ("MATCH_AUTHORIZED_IDENTIFIER_RELATION", "MATCH", None, 0, False, False),
    ("UNCERTAIN_MISSING_CRITICAL_ATTRIBUTES", "UNCERTAIN", None, 0, True, False), ("UNCERTAIN_IDENTIFIER_RELATION", "UNCERTAIN", None, 0, False, False),
    ("NO_MATCH_MPN_IDENTITY", "NO_MATCH", "MPN_IDENTITY", 1, False, True), ("NO_MATCH_PRODUCT_FAMILY", "NO_MATCH", "PRODUCT_FAMILY", 1, False, True), ("NO_MATCH_GENERATION", "NO_MATCH", "GENERATION", 1, False, True),
    ("NO_MATCH_CAPACITY", "NO_MATCH", "CAPACITY", 1, False, True), ("NO_MATCH_INTERFACE", "NO_MATCH", "INTERFACE", 1, False, True), ("NO_MATCH_FORM_FACTOR", "NO_MATCH", "FORM_FACTOR", 1, False, True),
    ("NO_MATCH_PRODUCT_ROLE", "NO_MATCH", "PRODUCT_ROLE", 1, False, True), ("NO_MATCH_ACCESSORY", "NO_MATCH", "ACCESSORY_RELATION", 1, False, True), ("NO_MATCH_PACKAGING", "NO_MATCH", "PACKAGING_QUANTITY", 1, False, True),
    ("NO_MATCH_BUNDLE", "NO_MATCH", "BUNDLE", 1, False, True), ("NO_MATCH_MULTIPLE_CONFLICTS", "NO_MATCH", None, 2, False, True), ("NO_MATCH_OTHER", "NO_MATCH", None, 0, False, True),
]


def _at(name: str) -> Column:
    return F.try_variant_get(F.col("_object"), f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("ABSENT"))


def _texts(value: Column) -> Column:
    """The entries of a list of texts, or null if it is none."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.when(F.forall(listed, lambda v: _kind(v) == "STRING"), F.transform(listed, lambda v: F.try_variant_get(v, "$", "string")))


def _attributes(value: Column) -> Column:
    """The entries of a list of objects that are exactly a dimension and a detail, or null."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    member = lambda v, n: F.try_variant_get(v, f"$.{n}", "variant")
    keys = lambda v: F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    good = lambda v: (
        (_kind(v) == "OBJECT") & F.coalesce(keys(v) == F.array(F.lit("detail"), F.lit("dimension")), F.lit(False)) & (_kind(member(v, "dimension")) == "STRING") & (_kind(member(v, "detail")) == "STRING")
    )
    read = lambda v: F.struct(F.try_variant_get(v, "$.dimension", "string").alias("dimension"), F.try_variant_get(v, "$.detail", "string").alias("detail"))
    return F.when(F.forall(listed, good), F.transform(listed, read))


def _once(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def _known(values: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.coalesce(F.forall(values, lambda v: v.isin(*vocabulary)) & _once(values), F.lit(False))


def _first(problems: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for wrong, name in reversed(problems):
        out = F.when(F.coalesce(wrong, F.lit(True)), name).otherwise(out)
    return out


def _opened(rows: DataFrame, raw: str, version: int) -> DataFrame:
    """Adds _object (a variant) and _shape (what is wrong with the whole)."""
    text = strip(F.col(raw))
    rows = rows.withColumn("_object", whole_json(text))
    keys = F.map_keys(F.try_variant_get("_object", "$", "map<string,variant>"))
    wanted = F.array(*map(F.lit, KEYS[version]))
    shape = [
        (F.coalesce(text, F.lit("")) == "", "EMPTY"),
        (text.startswith("```"), "CODE_FENCE"),
        (~(text.startswith("{") & text.endswith("}")), "NOT_AN_OBJECT"),
        (F.col("_object").isNull() | (_kind(F.col("_object")) != "OBJECT"), "INVALID_JSON"),
        (F.size(F.array_except(wanted, keys)) > 0, "MISSING_KEYS"),
        (F.size(F.array_except(keys, wanted)) > 0, "UNKNOWN_KEYS"),
    ]
    return rows.withColumn("_shape", _first(shape))


def _named(name: str, vocabulary: tuple[str, ...]) -> tuple[Column, str]:
    value = F.when(_kind(_at(name)) == "STRING", F.try_variant_get("_object", f"$.{name}", "string"))
    return ~F.coalesce(value.isin(*vocabulary), F.lit(False)), f"BAD_{name.upper()}"


def parsed_v1(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds problem (null for an answer that counts), decision, confidence, reason_code and the three lists
    of texts of answers of the first contract."""
    rows = _opened(rows, raw, 1)
    reason = F.when(_kind(_at("reason_code")) == "STRING", F.try_variant_get("_object", "$.reason_code", "string"))
    lists = {n: _texts(_at(n)) for n in LISTS}
    value = [_named("decision", DECISIONS), _named("confidence", CONFIDENCES), *((v.isNull(), f"BAD_{n.upper()}") for n, v in lists.items()), (strip(reason) == "", "BAD_REASON_CODE")]
    rows = rows.withColumn("problem", F.coalesce("_shape", _first(value)))
    good = lambda v: F.when(F.col("problem").isNull(), v)
    columns = {n: F.try_variant_get("_object", f"$.{n}", "string") for n in ("decision", "confidence")} | {"reason_code": reason} | lists
    return rows.withColumns({n: good(v) for n, v in columns.items()}).drop("_object", "_shape")


def parsed_v2(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds problem, decision, confidence, reason_code, matched_attributes and conflicting_attributes (dimension
    and detail), missing_critical_attributes and conflict_classes of answers of the second contract."""
    rows = _opened(rows, raw, 2)
    pairs = {n: _attributes(_at(n)) for n in LISTS[:2]}
    words = {n: _texts(_at(n)) for n in (LISTS[2], "conflict_classes")}
    rows = rows.withColumns({f"_{n}": v for n, v in (pairs | words).items()})
    value = [_named("decision", DECISIONS), _named("confidence", CONFIDENCES), _named("reason_code", tuple(r[0] for r in REASONS))]
    value += [(~(F.coalesce(F.forall(f"_{n}", lambda a: a["dimension"].isin(*DIMENSIONS)) & _once(F.col(f"_{n}")), F.lit(False))), f"BAD_{n.upper()}") for n in pairs]
    value += [(~_known(F.col(f"_{n}"), v), f"BAD_{n.upper()}") for n, v in zip(words, (DIMENSIONS, CLASSES), strict=True)]
    rows = rows.withColumn("_value", F.coalesce("_shape", _first(value)))
    names = ("decision", "confidence", "reason_code")
    rows = rows.withColumns({n: F.when(F.col("_value").isNull(), F.try_variant_get("_object", f"$.{n}", "string")) for n in names})
    return _coherent(rows, [*pairs, *words]).drop("_object", "_shape", "_value")


def _coherent(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Adds problem: what is wrong with a value, or how the reason does not fit the rest."""
    schema = "_code string, _decision string, _class string, _hard int, _missing boolean, _any boolean"
    rules = rows.sparkSession.createDataFrame(REASONS, schema)  # one row a reason
    rows = rows.join(F.broadcast(rules), F.col("reason_code") == F.col("_code"), "left")
    classes = F.col("_conflict_classes")
    hard = F.size(F.array_intersect(classes, F.array(*map(F.lit, ALWAYS_HARD))))
    fit = [
        (F.col("_code").isNull(), "NO_RULE"),
        (F.col("_decision") != F.col("decision"), "REASON_OF_ANOTHER_DECISION"),
        (F.col("_class").isNotNull() & ~F.array_contains(classes, F.col("_class")), "REASON_WITHOUT_ITS_CONFLICT"),
        (hard < F.col("_hard"), "TOO_FEW_HARD_CONFLICTS"),
        (F.col("_missing") & (F.size("_missing_critical_attributes") == 0), "NOTHING_MISSING"),
        (F.col("_any") & (F.size(classes) == 0), "NO_CONFLICT"),
        ((F.col("decision") != "NO_MATCH") & (hard > 0), "HARD_CONFLICT_HIDDEN"),
    ]
    rows = rows.withColumn("problem", F.coalesce("_value", _first(fit)))
    good = lambda v: F.when(F.col("problem").isNull(), v)
    rows = rows.withColumns({n: good(F.col(n)) for n in ("decision", "confidence", "reason_code")} | {n: good(F.col(f"_{n}")) for n in lists})
    return rows.drop("_code", "_decision", "_class", "_hard", "_missing", "_any", *(f"_{n}" for n in lists))
