"""Comparable products of a target: found on support pages, researched there, and compared."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.functions import part_number as pn
from quoteloom.functions.specs import KEYS, normalize
from quoteloom.operators import specs
from quoteloom.sources import support

SOURCE = ["page_id"]


def assessed(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Each candidate of ``support.candidates`` for each target of its page (``targets``: page_id,
    target_mpn) with its key and disposition: TARGET_SELF if it is the target, NO_KEY if nothing of its
    number can be compared, else CANDIDATE."""
    rows = found.hint("merge").join(targets.select("page_id", "target_mpn").distinct(), "page_id").withColumn("mpn_key", pn.key(F.col("mpn")))
    same = pn.compare(F.col("target_mpn"), F.col("mpn")).isin("EXACT", "NORMALIZED_EXACT")
    return rows.withColumn("disposition", F.when(F.col("mpn_key") == "", "NO_KEY").when(same, "TARGET_SELF").otherwise("CANDIDATE"))


def discovered(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """target_mpn, mpn_key, mpn (as first seen), title, raw_reference and evidence (records that name it)
    of each candidate of a target on ``pages`` (page_id, html). Only the key makes two records one."""
    rows = assessed(support.candidates(support.records(pages, *SOURCE), *SOURCE), targets).where("disposition = 'CANDIDATE'")
    order = F.struct(*SOURCE, *support.PLACE)
    first = F.min_by(F.struct("mpn", "title", "page_id", "raw_reference"), order).alias("first")
    found = rows.groupBy("target_mpn", "mpn_key").agg(first, F.count("*").alias("evidence"))
    return found.select("target_mpn", "mpn_key", "first.*", "evidence")


def researched(pages: DataFrame, products: DataFrame, authority: str = "AUTHORITATIVE", labels: dict[str, str] = support.LABELS) -> DataFrame:
    """The resolutions of every field of ``products`` (product_id, mpn) from the records of ``pages``;
    a field without evidence is UNKNOWN."""
    rows = support.specifications(support.records(pages, *SOURCE), products, *SOURCE, labels=labels)
    found = specs.resolve(normalize(rows.withColumn("source_authority", F.lit(authority))))
    every = products.select("product_id").distinct().select("product_id", F.explode(F.array(*map(F.lit, KEYS))).alias("definition_key"))
    state, usable = F.coalesce("state", F.lit("UNKNOWN")).alias("state"), F.coalesce("usable", F.lit(0)).alias("usable")
    return every.hint("merge").join(found, ["product_id", "definition_key"], "left").select("product_id", "definition_key", usable, state, "value_kind", "value_text", "value_dec")


def compared(pages: DataFrame, targets: DataFrame, labels: dict[str, str] = support.LABELS) -> DataFrame:
    """Coverage and similarity of each target and candidate, in no order of merit; both are researched on
    the pages that name them."""
    pairs = discovered(pages, targets).select(F.col("target_mpn").alias("target_id"), F.col("mpn").alias("candidate_id"))
    products = pairs.select(F.explode(F.array("target_id", "candidate_id")).alias("mpn")).distinct().select(F.col("mpn").alias("product_id"), "mpn")
    return specs.similarity(researched(pages, products, labels=labels), pairs)
