"""Resolution of specification evidence, and how alike two products are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = 12


def resolve(observations: DataFrame) -> DataFrame:
    """One row for each product and key: state UNKNOWN, CONFLICT, VERIFIED or UNVERIFIED, the value
    where there is one, and the number of usable observations. Only the least and greatest value
    are carried, so no product's evidence is gathered."""
    usable = F.col("issue").isNull()
    value = F.when(usable, F.struct("value_kind", "value_text", "value_dec"))
    found = observations.groupBy("product_id", "definition_key").agg(
        F.count_if(usable).alias("usable"), F.min(value).alias("_low"), F.max(value).alias("_high"), F.coalesce(F.bool_or(usable & (F.col("source_authority") == "AUTHORITATIVE")), F.lit(False)).alias("_proven")
    )
    state = F.when(F.col("usable") == 0, "UNKNOWN").when(F.col("_low") != F.col("_high"), "CONFLICT").when(F.col("_proven"), "VERIFIED").otherwise("UNVERIFIED")
    found = found.withColumn("state", state)
    one = F.when(F.col("state").isin("VERIFIED", "UNVERIFIED"), F.col("_low"))
    return found.select("product_id", "definition_key", "usable", "state", one["value_kind"].alias("value_kind"), one["value_text"].alias("value_text"), one["value_dec"].alias("value_dec"))


def united(*evidence: DataFrame) -> DataFrame:
    """Observations of several sources as one set; of equal ones the first counts, so evidence that two
    sources repeat is not stronger."""
    rows = None
    for k, part in enumerate(evidence):
        part = part.withColumn("_source", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c != "_source"]
    return rows.groupBy(*columns).agg(F.min("_source").alias("first_source"))


def coverage(resolutions: DataFrame, required: list[str]) -> DataFrame:
    """product_id, missing (the required keys without a value, in order) and whether all are there."""
    held = F.collect_set(F.when(F.col("value_kind").isNotNull(), F.col("definition_key")))  # at most FIELDS keys
    found = resolutions.groupBy("product_id").agg(held.alias("_held"))
    missing = F.array_except(F.array(*(F.lit(k) for k in required)), "_held")
    return found.select("product_id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


def field_similarity(pairs: DataFrame) -> DataFrame:
    """Adds field_similarity to rows with t_ and c_ values of one key: equal or not for text and
    flags, smaller by larger for numbers; null unless both have a value."""
    both = F.col("t_kind").isNotNull() & F.col("c_kind").isNotNull()
    ratio = F.least("t_dec", "c_dec").cast("double") / F.greatest("t_dec", "c_dec").cast("double")
    same = F.when(F.col("t_text") == F.col("c_text"), 1.0).otherwise(0.0)
    return pairs.withColumn("field_similarity", F.when(both, F.when(F.col("t_kind") == "DECIMAL", ratio).otherwise(same)))


def similarity(resolutions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Coverage, observed and evidence-weighted similarity of each (target_id, candidate_id).

    Each pair asks for its two products in one join, so the resolutions are computed once.
    """
    values = resolutions.where("value_kind IS NOT NULL").select("product_id", "definition_key", F.struct("value_kind", "value_text", "value_dec").alias("value"))
    sides = F.explode(F.array(F.struct(F.lit("t").alias("side"), F.col("target_id").alias("product_id")), F.struct(F.lit("c").alias("side"), F.col("candidate_id").alias("product_id"))))
    asked = pairs.select("target_id", "candidate_id").distinct().select("target_id", "candidate_id", sides.alias("s")).select("target_id", "candidate_id", "s.*")
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("value")))
    fields = asked.hint("merge").join(values, "product_id", "left").groupBy("target_id", "candidate_id", "definition_key").agg(side("t").alias("t"), side("c").alias("c"))
    fields = fields.select("target_id", "candidate_id", *(F.col(f"{p}.value_{k}").alias(f"{p}_{k}") for p in "tc" for k in ("kind", "text", "dec")))
    found = field_similarity(fields).groupBy("target_id", "candidate_id").agg(F.count("field_similarity").alias("scored"), F.sum(F.round("field_similarity", 9).cast("decimal(12,9)")).alias("total"))
    total = F.coalesce(F.col("total").cast("double"), F.lit(0.0))
    return found.select("target_id", "candidate_id", "scored", F.round(F.col("scored") / FIELDS, 6).alias("coverage"), F.when(F.col("scored") > 0, F.round(total / F.col("scored"), 6)).alias("observed"), F.round(total / FIELDS, 6).alias("evidence_weighted"))


def representatives(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first candidate of each group by ``order``, with the size of its group."""
    by = Window.partitionBy(*keys)
    ranked = candidates.withColumn("_place", F.row_number().over(by.orderBy(*order))).withColumn("group_size", F.count("*").over(by))
    return ranked.where("_place = 1").drop("_place")


def datasheet_values(cells: DataFrame, part_numbers: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Values of a part's column in datasheet tables (cells: document_id, page, table_index, row,
    col, text): the one column whose cell is the part number, and the rows that ``labels`` name
    (label text -> key), the first row of each key. A part number in several columns is ambiguous
    and has no values."""
    place = ["document_id", "page", "table_index"]
    wanted = part_numbers.select(F.upper(F.trim("part_number")).alias("_mpn"), "part_number").distinct()
    hits = cells.withColumn("_mpn", F.upper(F.trim("text"))).join(wanted, "_mpn").select(*place, "part_number", F.col("col").alias("_col"))
    count = F.count("*").over(Window.partitionBy("document_id", "part_number"))
    hits = hits.withColumn("_n", count).where("_n = 1").drop("_n")
    key = F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), F.lower(F.trim("text")))
    named = cells.withColumn("definition_key", key).where(F.col("definition_key").isNotNull()).select(*place, "row", "definition_key")
    found = cells.join(hits, place).where(F.col("col") == F.col("_col")).join(named, [*place, "row"])
    first = F.row_number().over(Window.partitionBy("document_id", "part_number", "definition_key").orderBy("page", "table_index", "row"))
    return found.withColumn("_place", first).where("_place = 1").select("document_id", "part_number", "definition_key", F.col("text").alias("raw_value"))
