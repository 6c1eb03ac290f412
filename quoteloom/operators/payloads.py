"""A run's price result as one versioned JSON payload, and back.

The payload holds the request, the assessments in their order, buckets and exclusions that name assessments
by index, and the verification status; keys are in alphabetical order, amounts are text, nulls are written
out. So it has one spelling only: what is decoded and encoded again must give the same bytes, which leaves no
room for a missing, unknown or repeated key, another type or order. A payload is replayed by deriving buckets,
exclusions and status from its assessments anew: they must be what it says.

One payload is one run's listings, which are few by nature; runs are dealt over the cluster.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.operators import aggregate, match
from quoteloom.operators.normalize import only

VERSION = 1
OBSERVED = ("availability_text", "brand_text", "condition_text", "currency_text", "extraction_method", "mpn_text", "price_text", "product_title", "seller_text", "sku_text", "source_url")
ORDER = ("url_ord", "listing_ord", "source_url", "price_text", "condition_text")  # listings of one place differ in these
PLAIN = {"ignoreNullFields": "false"}
ASSESSMENT = (
    "struct<decision:string,evidence_source:string,match_type:string,normalized_listing:struct<availability:string,condition:string,currency_code:string,issues:array<string>,"
    f"observation:struct<{','.join(f'{n}:string' for n in OBSERVED)}>,price_amount:string,seller_name:string>,place:array<bigint>,rejection_reason:string>"
)
BUCKET = "struct<assessment_indexes:array<bigint>,condition:string,confidence:string,count:bigint,currency_code:string,high:string,low:string,market_range_high:string,market_range_low:string,median:string>"
SCHEMA = f"assessments array<{ASSESSMENT}>, buckets array<{BUCKET}>, exclusions array<struct<assessment_index:bigint,reason:string>>, request struct<description:string,requested_mpn:string>, verification_status string"
# The vocabularies of a payload.
WORDS = {
    "decision": ("ACCEPTED", "REJECTED", "UNDECIDED"),
    "match_type": ("EXACT", "NORMALIZED_EXACT", "PARTIAL", "UNKNOWN"),
    "verification_status": ("UNKNOWN", "VERIFIED", "AMBIGUOUS"),
    "confidence": ("LOW", "MEDIUM", "HIGH"),
}


def encoded(rows: DataFrame, *told: str) -> DataFrame:
    """run_id, schema_version, payload and its SHA-256 of each run of assessed ``rows``; columns ``told``
    are kept, and tell runs of one name apart."""
    run = ["run_id", *told]
    rows = match.indexed(rows, run, *ORDER).withColumn("assessment_index", F.col("assessment_index").cast("bigint"))
    text = lambda n: F.col(n).cast("string").alias(n)
    listing = F.struct("availability", "condition", "currency_code", "issues", F.struct(*(text(n) for n in OBSERVED)).alias("observation"), text("price_amount"), "seller_name")
    place = F.array(F.col("url_ord").cast("bigint"), F.col("listing_ord").cast("bigint"))
    assessment = F.struct("decision", "evidence_source", "match_type", listing.alias("normalized_listing"), place.alias("place"), "rejection_reason")
    rows = rows.withColumn("reason", aggregate.exclusion_reason(F.col("decision") == "ACCEPTED"))
    # first what would be one bucket, with its rows, then the run: each row is computed once and carried once
    entry = F.struct("assessment_index", assessment.alias("assessment"), "reason")
    parts = rows.groupBy(*run, "currency_code", "condition", F.col("reason").isNull().alias("inside")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.min(F.struct("description", "requested_mpn")).alias("request"),
        F.count("*").alias("listings"), F.min("price_amount").alias("low"), F.max("price_amount").alias("high"), F.collect_list("price_amount").alias("_amounts"),
    )
    parts = aggregate.summarized(parts).withColumn("assessment_indexes", F.transform("entries", lambda e: e["assessment_index"]))
    amounts = {"high": "high", "low": "low", "market_range_high": "range_high", "market_range_low": "range_low", "median": "median"}
    bucket = F.struct("assessment_indexes", "condition", "confidence", F.col("listings").cast("bigint").alias("count"), "currency_code", *(F.col(c).cast("string").alias(n) for n, c in amounts.items()))
    runs = parts.groupBy(*run).agg(
        F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries"), F.min("request").alias("request"), F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct(F.col("assessment_indexes")[0].alias("first"), bucket.alias("bucket"))))).alias("found")
    )
    left = F.filter("entries", lambda e: e["reason"].isNotNull())
    n = F.size("found")
    body = F.struct(
        F.transform("entries", lambda e: e["assessment"]).alias("assessments"),
        F.transform("found", lambda b: b["bucket"]).alias("buckets"),
        F.transform(left, lambda e: F.struct(e["assessment_index"].alias("assessment_index"), e["reason"].alias("reason"))).alias("exclusions"),
        "request",
        F.when(n == 0, "UNKNOWN").when(n == 1, "VERIFIED").otherwise("AMBIGUOUS").alias("verification_status"),
    )
    runs = runs.select(*run, F.lit(VERSION).alias("schema_version"), F.to_json(body, PLAIN).alias("payload"))
    return runs.withColumn("sha256", F.sha2("payload", 256))


def _decoded(payloads: DataFrame) -> DataFrame:
    """Adds body (typed) and problem: the first thing wrong with a payload by itself."""
    rows = payloads.withColumn("body", F.from_json("payload", SCHEMA))
    rows = rows.withColumn("_again", F.to_json("body", PLAIN))
    each = F.col("body.assessments")
    n = F.size(each)
    word = lambda v, name: v.isin(*WORDS[name])
    listed = F.flatten(F.transform("body.buckets", lambda b: b["assessment_indexes"]))
    every = F.concat(listed, F.transform("body.exclusions", lambda e: e["assessment_index"]))
    amounts = F.flatten(F.transform("body.buckets", lambda b: F.array_compact(F.array(b["high"], b["low"], b["median"], b["market_range_high"], b["market_range_low"]))))
    amounts = F.concat(amounts, F.array_compact(F.transform(each, lambda a: a["normalized_listing"]["price_amount"])))
    words = F.forall(each, lambda a: word(a["decision"], "decision") & word(a["match_type"], "match_type")) & F.forall("body.buckets", lambda b: word(b["confidence"], "confidence")) & word(F.col("body.verification_status"), "verification_status")
    wrong = lambda v: F.coalesce(~v, F.lit(True))
    problem = (
        F.when(wrong(F.col("schema_version") == VERSION), "UNSUPPORTED_VERSION")
        .when(wrong(F.sha2("payload", 256) == F.col("sha256")), "DIGEST_MISMATCH")
        .when(wrong(F.col("_again") == F.col("payload")), "NOT_CANONICAL")
        .when(wrong(words), "UNKNOWN_WORD")
        .when(wrong(F.forall(amounts, lambda a: a.rlike("^[0-9]+\\.[0-9]+$") & a.try_cast("decimal(38,10)").isNotNull())), "BAD_AMOUNT")
        .when(wrong(F.forall(every, lambda i: i.between(0, n - 1)) & (F.size(F.array_distinct(every)) == F.size(every))), "BAD_INDEX")
    )
    return rows.withColumn("problem", problem).drop("_again")


def _rows(opened: DataFrame, *told: str) -> DataFrame:
    """The assessed rows, and ``told``, of run_id, request and assessments a, one a row."""
    listing = "a.normalized_listing"
    return opened.select(
        "run_id", *told, "request.*", F.col("a.place")[0].alias("url_ord"), F.col("a.place")[1].alias("listing_ord"), *(F.col(f"{listing}.observation.{n}").alias(n) for n in OBSERVED),
        F.col(f"{listing}.price_amount").cast(aggregate.AMOUNT).alias("price_amount"), *(F.col(f"{listing}.{n}").alias(n) for n in ("currency_code", "availability", "condition", "seller_name", "issues")),
        *(F.col(f"a.{n}").alias(n) for n in ("evidence_source", "match_type", "decision", "rejection_reason")),
    )


def decoded(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The assessed rows of payloads that are whole, and run_id with the problem of the others."""
    # a plain filter on the problem would read a payload anew at each place that its rules name it
    rows = _decoded(payloads)
    good, bad = only(rows, F.col("problem").isNull()), only(rows, F.col("problem").isNotNull())
    return _rows(good.select("run_id", F.col("body.request").alias("request"), F.explode("body.assessments").alias("a"))), bad.select("run_id", "problem")


def replayed(payloads: DataFrame) -> DataFrame:
    """run_id and outcome of each payload: REPLAYED where its assessments give all of it again, NOT_DERIVED
    where they give something else, or what is wrong with it.

    All payloads take one way, numbered so that each stays one: a broken one, or one without assessments,
    goes along as a single empty row whose outcome is known.
    """
    body = F.col("body")
    nothing = (F.size(body["buckets"]) == 0) & (F.size(body["exclusions"]) == 0) & (body["verification_status"] == "UNKNOWN")
    none = F.when(F.size(body["assessments"]) == 0, F.when(nothing, "REPLAYED").otherwise("NOT_DERIVED"))
    rows = _decoded(payloads).select("run_id", F.col("sha256").alias("claimed"), F.coalesce("problem", none).alias("known"), "body").withColumn("number", F.monotonically_increasing_id())
    told = ("number", "claimed", "known")
    opened = rows.select("run_id", *told, body["request"].alias("request"), F.explode_outer(F.when(F.col("known").isNull(), body["assessments"])).alias("a"))
    again = encoded(_rows(opened, *told), *told)
    return again.select("run_id", F.coalesce("known", F.when(F.col("sha256") == F.col("claimed"), "REPLAYED").otherwise("NOT_DERIVED")).alias("outcome"))
