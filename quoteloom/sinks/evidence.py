"""The log of a run's steps: checked rows, published a batch at a time, all of it once or not at all.

A batch's rows are written to a folder of their own, and then a commit is created under the batch's id: a
file that cannot be created twice and names the folder. Readers see committed folders only. So a batch that
is published again changes nothing, one that fails half-way leaves nothing to see, and of two writers of one
batch one wins. A batch with a row that must not be is refused as a whole. Attempts are numbered when
read, so no writer needs to know what others have written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.operators.logs import numbered

# The details that each outcome of a stage may have; None stands for no detail.
ALLOWED = {
    ("SEARCH", "SUCCESS"): ("OK", "ZERO_RESULTS"),
    ("SEARCH", "FAILED"): ("PROVIDER_ERROR", "TIMEOUT"),
    ("FETCH", "SUCCESS"): ("OK",),
    ("FETCH", "BLOCKED"): ("SAFE_URL_REFUSED",),
    ("FETCH", "FAILED"): ("NETWORK_ERROR", "HTTP_ERROR", "TIMEOUT"),
    ("FETCH", "SKIPPED"): (None,),
    ("EXTRACT", "SUCCESS"): ("OK",),
    ("EXTRACT", "EMPTY"): ("NO_LISTING_OBSERVATIONS",),
    ("EXTRACT", "FAILED"): ("PARSE_ERROR",),
    ("NORMALIZE", "SUCCESS"): ("OK", "NO_PRICE"),
    ("NORMALIZE", "FAILED"): (None,),
    ("MATCH", "SUCCESS"): ("ACCEPTED", "IDENTITY_REJECTED", "NO_MPN_IN_OBSERVATION", None),
    ("MATCH", "FAILED"): (None,),
    ("AGGREGATE", "SUCCESS"): (None,),
    ("AGGREGATE", "FAILED"): (None,),
    ("SEMANTIC", "SUCCESS"): ("SEMANTIC_MATCH", "SEMANTIC_NO_MATCH", "SEMANTIC_UNCERTAIN"),
    ("SEMANTIC", "FAILED"): ("SEMANTIC_UNAVAILABLE",),
}
COLUMNS = "run_id long, seq long, stage string, outcome string, detail_code string, candidate_url string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _has_host(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://[^\\s/?#]") & (F.try_parse_url(url, F.lit("HOST")) != ""), F.lit(False))


def checked(entries: DataFrame) -> DataFrame:
    """The columns of ``entries`` with problem (null for a row that may be): UNKNOWN_STEP, BAD_DETAIL or
    BAD_URL. An address with credentials is kept as none."""
    url = F.coalesce("candidate_url", F.lit(""))
    step = F.concat_ws("/", "stage", "outcome")
    table = F.create_map(*(x for (s, o), details in ALLOWED.items() for x in (F.lit(f"{s}/{o}"), F.array(*(F.lit(d or "") for d in details)))))
    allowed = F.try_element_at(table, step)
    detail = F.array_contains(allowed, F.coalesce("detail_code", F.lit("")))
    problem = F.when(allowed.isNull(), "UNKNOWN_STEP").when(~detail, "BAD_DETAIL").when((url != "") & ~_has_host(url), "BAD_URL")
    secret = F.coalesce(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), F.lit(False))
    return entries.withColumns({"problem": problem, "candidate_url": F.when(secret, "").otherwise(url), "detail_code": F.coalesce("detail_code", F.lit(""))})


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, folder: str, batch: int, data: str) -> bool:
    """Whether the commit of the batch is ours."""
    at, store = _store(spark, f"{folder}/commits/{batch}-of")
    store.mkdirs(at.getParent())
    try:
        out = store.create(at, False)
    except Exception as e:  # noqa: BLE001  # py4j's own error, whatever the store raises
        if store.exists(at):
            return False
        raise e
    out.writeUTF(data)
    out.close()
    return True


def publish(entries: DataFrame, folder: str, batch: int) -> str:
    """Writes a batch of entries (COLUMNS): PUBLISHED, REPEATED if the batch is there already, or REFUSED
    with nothing written if any row has a problem."""
    spark, folder = entries.sparkSession, folder.rstrip("/")
    at, store = _store(spark, f"{folder}/commits/{batch}-of")
    if store.exists(at):
        return "REPEATED"
    rows = checked(entries)
    data = f"data-{uuid.uuid4().hex}"
    # checked and written in one pass; a refused batch's folder is in no commit and goes
    rows.select(*NAMES, "problem").write.parquet(f"{folder}/{data}")
    bad = not spark.read.parquet(f"{folder}/{data}").where("problem is not null").isEmpty()
    ours = not bad and _commit(spark, folder, batch, data)
    if not ours:
        path, store = _store(spark, f"{folder}/{data}")
        store.delete(path, True)
    return "REFUSED" if bad else "PUBLISHED" if ours else "REPEATED"


def committed(spark: SparkSession, folder: str) -> dict[int, str]:
    """The folder of each published batch."""
    at, store = _store(spark, f"{folder.rstrip('/')}/commits")
    found = {}
    for status in store.listStatus(at) if store.exists(at) else []:
        source = store.open(status.getPath())
        found[int(status.getPath().getName().removesuffix("-of"))] = source.readUTF()
        source.close()
    return found


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The published entries with attempt_number (from 1 in a run, by batch and seq) and problem, which is
    null unless the log was changed by others."""
    parts = committed(spark, folder)
    rows = spark.createDataFrame([], f"batch long, {COLUMNS}")
    if parts:
        names = spark.createDataFrame(list(parts.items()), "batch long, _data string")  # a row a batch
        files = spark.read.schema(f"{COLUMNS}, problem string").parquet(*(f"{folder.rstrip('/')}/{d}" for d in parts.values()))
        part = F.regexp_extract(F.input_file_name(), "(data-[0-9a-f]{32})", 1)
        rows = files.select(*NAMES, part.alias("_data")).join(F.broadcast(names), "_data").select("batch", *NAMES)
    return checked(numbered(rows, "run_id", ["batch", "seq"]))
