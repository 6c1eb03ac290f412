"""The queries op1 to op13 over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.llm import decontaminate, licenses, line_dedup, mixing, pii, secrets, spelling, toxicity, trie, vector_search, warc
from quoteloom.llm.common import table
from quoteloom.llm.simhash import near_duplicates
from quoteloom.llm.suffix_dedup import remove_repeats


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = mixing.virtual_times(table(spark, sf_dir, "documents"))
    return times.select("doc_id", "size", "source_size", "target", "taken")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents")).drop("found")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "token", "place", F.length("secret").cast("long").alias("length"), F.sha2("secret", 256).alias("secret_sha256"), "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, machine).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def misspelt(doc_id: int | None, run: bytes) -> bytes:
    """A run, one code point of which is left out where 31 divides a hash of doc_id and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode() + run)
    if h % 31:
        return run
    word = run.decode()
    return (word[: h % len(word)] + word[h % len(word) + 1 :]).encode()


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(table(spark, sf_dir, "documents"), misspelt))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), trie.BLOCK)


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_weighted_mix": op2_weighted_mix,
    "op3_personal_data": op3_personal_data,
    "op4_decontaminate": op4_decontaminate,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_vector_search": op8_vector_search,
    "op9_license_scan": op9_license_scan,
    "op10_simhash_golay": op10_simhash_golay,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_warc_archives": op13_warc_archives,
}

ORACLES: dict[str, str] = {
    "op2_weighted_mix": mixing.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_conversation_trie": trie.SQL,
    "op13_warc_archives": warc.SQL,
}
