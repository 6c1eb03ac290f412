"""Product records that support pages hand to their scripts, as rows.

A page's script sets ``supportSpecsData`` to ``JSON.parse`` of a quoted text, a list of records. Python
finds that text and takes the escapes of the script's language out of it, in Arrow batches; Spark's JSON
reader does the rest. Any other variable, markup or visible text is not looked at. A text that is no list
is skipped, others of the page are not affected; so is one with a key twice in an object.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.text import collapsed, lookup, strip, whole_json

# The variable, what must stand behind it, and the letters that an escape stands for.
VARIABLE, CALL = "supportSpecsData", ("=", "JSON.parse('")
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "'": "'", "\\": "\\"}
# The labels of features that name a field.
LABELS = {"form factor": "physical_form_factor"}
PLACE = ["script", "block", "record"]


def _scripts(html: str) -> Iterator[str]:
    """The content of each script element that has an end."""
    low, at = html.lower(), 0
    while (start := low.find("<script", at)) >= 0 and (opened := low.find(">", start)) >= 0:
        end = low.find("</script>", opened)
        if end < 0:
            return
        yield html[opened + 1 : end]
        at = end + 9


def _quoted(text: str) -> tuple[str, str] | None:
    """The text up to the quote that ends it, without its escapes, and what follows."""
    parts, at = [], 0
    while True:
        quote, escape = text.find("'", at), text.find("\\", at)
        if quote < 0:
            return None
        if escape < 0 or quote < escape:
            return "".join([*parts, text[at:quote]]), text[quote + 1 :]
        letter, code = text[escape + 1 : escape + 2], text[escape + 2 : escape + 6]
        parts.append(text[at:escape])
        if letter == "u" and len(code) == 4 and all(c in "0123456789abcdefABCDEF" for c in code):
            parts.append(chr(int(code, 16)))
            at = escape + 6
        elif letter in ESCAPES:
            parts.append(ESCAPES[letter])
            at = escape + 2
        else:  # not an escape: both stay
            parts.append("\\")
            at = escape + 1


def payloads(html: str | None) -> list[dict]:
    """script, block (numbers from 0 in the page, in the script) and text of each assignment."""
    out = []
    for script, content in enumerate(_scripts(html or "")):
        block, at = 0, content.find(VARIABLE)
        while at >= 0:
            before, rest = content[:at], content[at + len(VARIABLE) :]
            if before[-1:].isspace() and before.rstrip().endswith("var") and (found := _argument(rest)) is not None:
                out.append({"script": script, "block": block, "text": found.encode("utf-8", "replace").decode()})
                block += 1
            at = content.find(VARIABLE, at + 1)
    return out


def _argument(rest: str) -> str | None:
    """The text that a call right behind the variable is given."""
    for mark in CALL:
        rest = rest.lstrip()
        if not rest.startswith(mark):
            return None
        rest = rest[len(mark) :]
    found = _quoted(rest)
    return found[0] if found and found[1].startswith(")") else None


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("script", pa.int32()), ("block", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        names = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([payloads(t.as_py()) for t in batch.column("html")], kind)], [*names, "found"])


def records(pages: DataFrame, *keys: str) -> DataFrame:
    """``keys``, script, block, record (numbers from 0), sku and value (a variant) of each record with a
    textual skuNumber of ``pages`` (with html)."""
    pages = pages.select(*keys, "html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema)
    read = pages.mapInArrow(_payloads, f"{schema}, found array<struct<script:int,block:int,text:string>>").select(*keys, F.inline("found"))
    listed = F.try_variant_get(whole_json(F.col("text")), "$", "array<variant>")
    rows = read.select(*keys, "script", "block", F.posexplode(listed).alias("record", "value"))
    return rows.select("*", text(F.col("value"), "skuNumber").alias("sku")).where("sku is not null")


def text(value: Column, name: str) -> Column:
    """A member of a variant if it is text."""
    member = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(member, "$", "string"))


def reference() -> Column:
    """Where a record stands."""
    return F.concat(F.lit("embedded_json["), F.col("script"), F.lit("]["), F.col("block"), F.lit("].record["), F.col("record"), F.lit("]"))


def candidates(found: DataFrame, *keys: str) -> DataFrame:
    """``keys``, place, mpn, title and raw_reference of each record of ``records`` that can be a product."""
    return found.where(strip(F.col("sku")) != "").select(*keys, *PLACE, F.col("sku").alias("mpn"), text(F.col("value"), "title").alias("title"), reference().alias("raw_reference"))


def specifications(found: DataFrame, products: DataFrame, *keys: str, labels: dict[str, str] = LABELS) -> DataFrame:
    """``keys``, product_id, definition_key, raw_value and raw_reference of the labelled features of the
    records that are exactly one of ``products`` (product_id, mpn). Values stay as they are."""
    # records come out of texts, whose size Spark takes for that of the file: neither side is to be broadcast
    rows = found.hint("merge").join(products.select("product_id", "mpn"), F.col("sku") == F.col("mpn"))
    listed = F.try_variant_get("value", "$.features", "array<variant>")
    rows = rows.select(*keys, "product_id", reference().alias("place"), F.posexplode(listed).alias("n", "feature"))
    label, value = F.lower(collapsed(text(F.col("feature"), "title"))), text(F.col("feature"), "value")
    rows = rows.select(*keys, "product_id", lookup(label, labels).alias("definition_key"), value.alias("raw_value"), F.concat("place", F.lit(".features["), "n", F.lit("]")).alias("raw_reference"))
    return rows.where(F.col("definition_key").isNotNull() & (strip(F.col("raw_value")) != ""))


def datasheet_links(found: DataFrame, *keys: str) -> DataFrame:
    """``keys``, sku, outcome (LINK, ABSENT, or AMBIGUOUS where several records have the number) and the
    datasheet's path of each part number of a page."""
    path = text(F.col("value"), "datasheet")
    rows = found.where(strip(F.col("sku")) != "").select(*keys, "sku", F.when(strip(path) != "", path).alias("path")).groupBy(*keys, "sku")
    rows = rows.agg(F.count("*").alias("n"), F.max("path").alias("path"))
    outcome = F.when(F.col("n") > 1, "AMBIGUOUS").when(F.col("path").isNull(), "ABSENT").otherwise("LINK")
    return rows.select(*keys, "sku", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("path")).alias("path"))
