"""Packaging aliases of a part number: catalog evidence, the relation, and what refers to it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions import part_number as pn
from quoteloom.functions.text import once

# Words of a description that name a memory module, so no drive.
MODULE_WORDS = ["DDR2", "DDR3", "DDR4", "DDR5", "DIMM", "DRAM", "LPCAMM", "LPCAMM2", "RDIMM", "SODIMM", "UDIMM"]
# Wording of compatibility rather than identity.
COMPATIBLE = ["compatible", "replacement", "interchangeable", "drop-in"]


def _same(one: Column, two: Column) -> Column:
    """Whether two keys are one part's; nothing has none."""
    return F.coalesce((one == two) & (one != ""), F.lit(False))


def established(one: Column, two: Column) -> Column:
    """Whether two part numbers compare as exact, be it normalized: equal texts have equal keys."""
    return _same(pn.key(one), pn.key(two))


def _token(words: list[str]) -> str:
    return f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(words)})(?![A-Za-z0-9])"


def module_words(description: Column) -> Column:
    """The memory-module words that stand in a description as tokens, in order."""
    found = F.array(*(F.when(F.coalesce(description.rlike(_token([w])), F.lit(False)), w) for w in MODULE_WORDS))
    return F.array_compact(found)


def compatibility_wording(text: Column) -> Column:
    return F.coalesce(text.rlike(_token(COMPATIBLE)), F.lit(False))


def aliases(requested: Column, base: Column) -> Column:
    """The other packaging forms of a catalog's base part number, in the order base, R, T; null unless
    the request is exactly one of the forms and comes to the base without its own final letter."""
    family = F.array(base, F.concat(base, F.lit("R")), F.concat(base, F.lit("T")))
    marked = once(pn.key(requested), lambda asked: F.transform(family, lambda m: F.struct(m.alias("name"), _same(asked, pn.key(m)).alias("own"))))
    fits = established(pn.alias_base(requested), base)

    def others(members: Column) -> Column:
        return F.when(F.size(F.filter(members, lambda m: m["own"])) == 1, F.transform(F.filter(members, lambda m: ~m["own"]), lambda m: m["name"]))

    return F.when(fits, once(marked, others))


def reference(names: Column, published: Column) -> Column:
    """The first of the aliases that a published part number is, or null."""
    found = once(pn.key(published), lambda asked: F.filter(names, lambda a: _same(asked, pn.key(a))))
    return F.when(F.coalesce(published != "", F.lit(False)), F.try_element_at(found, F.lit(1)))


def source_outcome(observations: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (policy_id, requested_mpn) how many records of its source it matches:
    MATCHED (exactly one, then source_mpn), AMBIGUOUS_MPN_MATCH or NO_MPN_IN_SOURCE.
    ``observations``: policy_id, source_mpn."""
    keyed = requests.withColumn("_key", pn.key(F.col("requested_mpn")))
    found = observations.withColumn("_key", pn.key(F.col("source_mpn"))).where("_key <> ''")
    counts = found.groupBy("policy_id", "_key").agg(F.count("*").alias("_n"), F.min("source_mpn").alias("_one"))
    joined = keyed.join(counts, ["policy_id", "_key"], "left")
    state = F.when(F.coalesce("_n", F.lit(0)) == 0, "NO_MPN_IN_SOURCE").when(F.col("_n") > 1, "AMBIGUOUS_MPN_MATCH").otherwise("MATCHED")
    return joined.select(*requests.columns, state.alias("outcome"), F.when(F.col("_n") == 1, F.col("_one")).alias("source_mpn"))
