"""Captured answers of a vendors' service to offers: JSON documents, or text with a section a vendor.

An answer (run_id, body) is JSON if it parses as such. Otherwise its lines are looked through for the
headings of the known vendors, plain or right behind an exact ``<p>``; a section is the text from its
heading to the next one, the first of each vendor counts, and its value is ``{Not Found}`` or one
mapping in the notation of a program's literals, after which any text is ignored. Spelling that notation
as JSON is all that Python does here; what is in it, Spark's parser decides. From then on both forms are
rows with a variant column and take the same way.

A broken section is an issue of its own and leaves the others as they are. Bodies over ``MOST_BYTES`` or
not in UTF-8, and JSON that is neither object nor list, give no rows; ``lookups`` tells them as failed.
JSON with a key twice in one object counts as broken. The sections of one JSON object are numbered in the
order of their keys.
"""

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions.text import SPACE, blank_to_null, strip, whole_json
from quoteloom.operators.normalize import only

MOST_BYTES = 1_048_576
MOST_DEPTH = 32
MOST_ENTRIES = 256

# The vendors and the headings of their sections.
HEADINGS = {"Ingram Product": "Ingram", "CDW Product": "CDW", "Synnex EU Product": "Synnex EU"}
# The keys that tell a vendor's section in a JSON object, and whose it is.
MARKS = {"vendorPartNumber": "Ingram", "manufacturerPartNumber": "CDW", "OnlineCheck": "Synnex EU", "ManufacturerItemIdentifier": "Synnex EU"}
OTHER_MARKS = ("sourceName", "NotFound", "notFound", "Not Found", "notMaintained")
# What a paragraph's text writes otherwise, and nothing else.
ENTITIES = {"&quot;": '"', "&#xA;": "\n", "&#xD;": "\r"}
# The words and the escapes of literals.
NAMES = {"True": "true", "true": "true", "False": "false", "false": "false", "None": "null", "null": "null"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "'": "'", '"': '"', "\\": "\\"}

BREAKS = "\\r\\n?|[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"  # all but \n itself
# a section's first line, and the section with the lines up to the next one's; both of text whose only break is \n
HEADING = "[\\p{IsWhite_Space}\\x1f&&[^\\n]]*(<p>)?(" + "|".join(HEADINGS) + f"):(?={SPACE}|\\z)"
SECTION = f"(?dm)^{HEADING}[^\\n]*+(?:\\n(?!{HEADING})[^\\n]*+)*+\\n?"
TOKEN = re.compile(r"""\s*(?:(?P<mark>[{}\[\],:])|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))|(?P<name>[A-Za-z0-9_]+))""", re.DOTALL)
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.DOTALL)


_quoted = json.JSONEncoder().encode


def _spelled(kind: str, token: str) -> str:
    """A token as JSON; KeyError for a name or an escape that there is not."""
    if kind == "text":
        bare = token[1:-1]
        return _quoted(ESCAPE.sub(lambda e: chr(int(e[1], 16)) if e[1] else ESCAPES[e[2]], bare) if "\\" in bare else bare)
    return format(Decimal(token), "f") if kind == "number" else NAMES[token]


def literal_json(text: str) -> str | None:
    """The literal that ``text`` begins with, as JSON, or null where it is not made of tokens that make
    one, is too deep, or holds too much. Order of tokens is left to the reader of the JSON."""
    out, entries, place = [], [], 0
    for found in TOKEN.finditer(text):
        if found.start() != place:
            return None
        kind, place = found.lastgroup, found.end()
        token = found[kind]
        if kind != "mark":
            try:
                out.append(_spelled(kind, token))
            except KeyError:
                return None
        elif token in "}]":
            if out and out[-1] == ",":  # one comma may follow the last entry
                out.pop()
                entries[-1] -= 1
                if out[-1] in ("{", "[", ",", ":"):
                    return None
            out.append(token)
            if not entries or entries.pop() > MOST_ENTRIES:
                return None
        else:
            out.append(token)
            if token in "{[":
                entries.append(1)
                if len(entries) > MOST_DEPTH:
                    return None
            elif token == "," and entries:
                entries[-1] += 1
        if not entries:
            return " ".join(out)
    return None


def _literals(texts: pd.Series) -> pd.Series:
    return texts.map(literal_json, na_action="ignore")


def sections(bodies: DataFrame) -> DataFrame:
    """run_id, source_name and text (of its value, entities of paragraphs decoded) of each vendor's
    first section of text bodies (run_id, body)."""
    found = F.regexp_extract_all(F.regexp_replace("body", BREAKS, "\n"), F.lit(SECTION), F.lit(0))
    rows = bodies.select("run_id", F.posexplode(found).alias("ord", "s"))
    head = lambda k: F.regexp_extract("s", f"^{HEADING}", k)
    rows = rows.select("run_id", "ord", "s", head(1).alias("p"), head(2).alias("heading"), F.length(head(0)).alias("begin"))
    names = F.create_map(*(F.lit(x) for pair in HEADINGS.items() for x in pair))
    text = decoded = F.substr("s", F.col("begin") + 1)
    for entity, meant in ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(meant))
    rows = rows.select("run_id", "ord", names[F.col("heading")].alias("source_name"), F.when(F.col("p") != "", decoded).otherwise(text).alias("text"))
    first = F.min_by("text", "ord").alias("text")
    return rows.groupBy("run_id", "source_name").agg(first, F.min("ord").alias("ord"))


def _kind(value: Column) -> Column:
    """The kind of a variant by its first word, ABSENT for none."""
    return F.coalesce(F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1), F.lit("ABSENT"))


def _given(value: Column) -> Column:
    """A variant, null where it is absent or a JSON null."""
    return F.when(~F.is_variant_null(value), value)


def _at(*names: str) -> Column:
    return F.try_variant_get(F.col("section"), "$" + "".join(f"['{n}']" for n in names), "variant")


def _text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _flag(value: Column) -> Column:
    return F.when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def _amount(value: Column) -> Column:
    """A price from a number or the text of one, not negative."""
    amount = F.when(_kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "STRING"), strip(F.try_variant_get(value, "$", "string")).try_cast("decimal(38,10)"))
    return F.when(amount >= 0, amount)


def _count(value: Column) -> Column:
    """A quantity from a whole number, not negative; text is none."""
    number = F.when(_kind(value).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(value, "$", "decimal(38,10)"))
    return F.when((number >= 0) & (number == F.floor(number)), number).cast("long")


def _holds(value: Column) -> Column:
    """Whether a value says yes: anything but absent, null, false, zero and empty ones."""
    text = F.to_json(value)
    return F.coalesce(~text.isin("null", "false", '""', "[]", "{}") & F.coalesce(text.try_cast("double") != 0, F.lit(True)), F.lit(False))


def json_sections(bodies: DataFrame) -> DataFrame:
    """run_id, ord, source_name (null for an unknown vendor) and section of JSON bodies (run_id, body as
    a variant): the objects of a list, or those values of an object that look like a section.

    A section is a vendor's by its sourceName (else by its key in the object), then by what it holds.
    """
    spark = bodies.sparkSession
    parts = spark.tvf.variant_explode(F.col("body").outer()).select("pos", "key", F.col("value").alias("section"))
    rows = bodies.lateralJoin(parts).where(F.col("section").isNotNull() & (_kind(F.col("section")) == "OBJECT"))
    marked = [_at(n).isNotNull() for n in (*MARKS, *OTHER_MARKS)]
    rows = rows.where(F.col("key").isNull() | F.greatest(*marked))
    by_key = F.when(F.col("key").isin(*HEADINGS.values()), F.col("key"))
    named = F.lower(F.when(_at("sourceName").isNotNull(), _text(_at("sourceName"))).otherwise(by_key))
    owner = F.when(named.contains("ingram"), "Ingram").when(named.contains("cdw"), "CDW").when(named.contains("synnex"), "Synnex EU")
    for mark, source in MARKS.items():
        owner = owner.when(_at(mark).isNotNull(), source)
    return rows.select("run_id", F.col("pos").alias("ord"), owner.alias("source_name"), "section")


def _ingram() -> dict[str, Column]:
    pricing, stock = _given(_at("pricing")), _at("availability")
    nested, held = pricing.isNotNull(), _kind(stock) == "OBJECT"
    either = lambda a, b: F.when(nested, a).otherwise(b)
    customer, retail = (either(_at("pricing", n), _at(n)) for n in ("customerPrice", "retailPrice"))
    return {
        "mpn": _at("vendorPartNumber"),
        "price": F.coalesce(customer, retail),
        "basis": F.when(customer.isNotNull(), "CUSTOMER_PRICE").otherwise("RETAIL_PRICE_FALLBACK"),
        "currency": either(_at("pricing", "currencyCode"), _at("currency")),
        "flag": F.when(nested & held, _at("availability", "available")).when(nested, stock).otherwise(_at("available")),
        "number": F.when(nested & held, _at("availability", "Avl_Quantity")).when(nested, _at("Avl_Quantity")).otherwise(_at("quantity")),
        "alone": ~nested,
        "whole": ~nested | (_kind(pricing) == "OBJECT"),
    }


def _cdw() -> dict[str, Column]:
    inventory = _given(_at("inventoryStatus"))
    held = _kind(inventory) == "OBJECT"
    return {
        "mpn": _at("manufacturerPartNumber"),
        "price": _at("price"),
        "currency": F.coalesce(_given(_at("currencyCode")), _at("currency")),
        "status": F.when(held, _at("inventoryStatus", "stockStatus")).otherwise(_at("stockStatus")),
        "number": F.when(held, _at("inventoryStatus", "Avl_Quantity")).otherwise(F.coalesce(_given(_at("Avl_Quantity")), _at("quantity"))),
        "alone": inventory.isNull(),
    }


def _synnex() -> dict[str, Column]:
    nested = _given(_at("OnlineCheck")).isNotNull()
    field = lambda n: F.when(nested, _at("OnlineCheck", "Item", n)).otherwise(_at(n))
    return {
        "mpn": field("ManufacturerItemIdentifier"),
        "price": field("UnitPriceAmount"),
        "currency": F.when(nested, _at("OnlineCheck", "Header", "CurrencyCode")).otherwise(F.coalesce(_given(_at("currency")), _at("CurrencyCode"))),
        "number": field("AvailabilityTotal"),
        "digits": nested,
        "note": field("Note"),
        "absent": _holds(_at("notMaintained")),
        "whole": ~nested | (_kind(_at("OnlineCheck", "Item")) == "OBJECT"),
        "currency_first": F.lit(True),
    }


# What a vendor's form does not have. alone: the quantity tells the stock where nothing else does; digits: it may be text.
NOTHING = {"mpn": "variant", "price": "variant", "currency": "variant", "flag": "variant", "status": "variant", "number": "variant", "note": "variant"}
USUAL = {"basis": "LIST_PRICE", "alone": True, "digits": False, "absent": False, "whole": True, "currency_first": False}


def _fields(mapper: dict[str, Column]) -> Column:
    """The values that a vendor's form holds, wherever they stand in it."""
    empty = {n: F.lit(None).cast(kind) for n, kind in NOTHING.items()} | {n: F.lit(v) for n, v in USUAL.items()}
    return F.struct(*(value.alias(n) for n, value in (empty | mapper).items()))


def _availability() -> Column:
    """Stock by the vendor's word, by its flag and the quantity together, or by the quantity alone; what
    they contradict is unknown."""
    some, none = F.col("quantity") > 0, F.col("quantity") == 0
    by_word = F.when(F.col("word") == "InStock", F.when(none, "UNKNOWN").otherwise("IN_STOCK")).when(F.col("word") == "OutOfStock", F.when(some, "UNKNOWN").otherwise("OUT_OF_STOCK"))
    by_flag = by_word.when(F.col("in_stock"), F.when(none, "UNKNOWN").otherwise("IN_STOCK")).when(~F.col("in_stock"), F.when(none, "OUT_OF_STOCK").otherwise("UNKNOWN"))
    speaks = (F.col("source_name") == "Ingram") | F.col("alone")  # a positive quantity beside a form's own flag does
    return by_flag.when(some & speaks, "IN_STOCK").when(none & F.col("alone"), "OUT_OF_STOCK").otherwise("UNKNOWN")


def mapped(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` (source_name, section; outcome where one is known already) with outcome
    (OK, NOT_FOUND, MISSING_EXPLICIT_MPN or MALFORMED_SECTION) and, for an OK one, the offer.

    Values are picked out by vendor, then read, then judged; each step is a table of its own, which keeps
    the generated code small.
    """
    source = F.col("source_name")
    fields = F.when(source == "Ingram", _fields(_ingram())).when(source == "CDW", _fields(_cdw())).otherwise(_fields(_synnex()))
    says_no = F.exists(F.array(*(_holds(_at(n)) for n in ("NotFound", "notFound", "Not Found"))), lambda x: x)
    whole = source.isNotNull() & (_kind(F.col("section")) == "OBJECT")
    picked = rows.select("run_id", "ord", "source_name", F.col("outcome").alias("known"), whole.alias("is_section"), says_no.alias("says_no"), F.inline(F.array(fields)))
    mpn, number = F.col("mpn"), F.col("number")
    digits = F.when(F.col("digits") & _text(number).rlike("^[0-9]{1,15}$"), _text(number).try_cast("long"))
    read = F.struct(
        blank_to_null(_text(mpn)).alias("explicit_mpn"),
        (_given(mpn).isNotNull() & (_kind(mpn) != "STRING")).alias("odd_mpn"),
        _amount(F.col("price")).alias("amount"),
        F.upper(blank_to_null(_text(F.col("currency")))).alias("currency_code"),
        F.coalesce(_count(number), digits).alias("quantity"),
        _flag(F.col("flag")).alias("in_stock"),
        _text(F.col("status")).alias("word"),
        F.lower(_text(F.col("note"))).alias("said"),
    )
    kept = ["run_id", "ord", "source_name", "known", "is_section", "says_no", "basis", "alone", "absent", "whole", "currency_first"]
    rows = picked.select(*kept, F.inline(F.array(read)))
    says = lambda words: F.coalesce(F.col("said").contains(words), F.lit(False))
    rough = ~F.col("whole") | F.col("currency_code").isNull()
    outcome = (
        F.when(F.col("known").isNotNull(), F.col("known"))
        .when(~F.col("is_section"), "MALFORMED_SECTION")
        .when(F.col("says_no") | F.col("absent") | says("not maintained"), "NOT_FOUND")
        .when(F.col("currency_first") & rough, "MALFORMED_SECTION")
        .when(F.col("odd_mpn"), "MALFORMED_SECTION")
        .when(F.col("explicit_mpn").isNull(), "MISSING_EXPLICIT_MPN")
        .when(rough | F.col("amount").isNull(), "MALFORMED_SECTION")
        .otherwise("OK")
    )
    rows = rows.withColumn("outcome", outcome)
    offer = {
        "explicit_mpn": F.col("explicit_mpn"),
        "price": F.col("amount"),
        "currency_code": F.col("currency_code"),
        "availability": _availability(),
        "quantity": F.col("quantity"),
        "price_basis": F.col("basis"),
        "note_kind": F.when(says("no return"), "NO_RETURNS"),
    }
    return rows.select("run_id", "ord", F.coalesce("source_name", F.lit("Unknown")).alias("source_name"), "outcome", *(F.when(F.col("outcome") == "OK", v).alias(n) for n, v in offer.items()))


def _read(answers: DataFrame) -> DataFrame:
    """run_id, body (text; null where it cannot be read) and json (a variant, where it is JSON)."""
    raw = F.col("body").cast("binary")
    body = F.when(F.octet_length(raw) <= MOST_BYTES, F.try_validate_utf8(raw.cast("string")))
    return answers.select("run_id", body.alias("body")).withColumn("json", whole_json(F.col("body")))


def offers(answers: DataFrame) -> DataFrame:
    """run_id, ord, source_name, outcome, explicit_mpn, price, currency_code, availability, quantity,
    price_basis and note_kind of each vendor's section of answers (run_id, body)."""
    read = _read(answers)
    plain = sections(only(read, F.expr("json is null and body is not null")))
    absent = F.when(F.col("text").rlike(f"^{SPACE}*\\{{{SPACE}*Not{SPACE}+Found{SPACE}*\\}}"), "NOT_FOUND")
    starts = F.ltrim(F.col("text")).startswith("{") | strip(F.col("text")).startswith("{")
    spelled = F.pandas_udf(_literals, "string")(F.when(absent.isNull() & starts, strip(F.col("text"))))
    plain = plain.withColumn("outcome", absent).withColumn("section", F.try_parse_json(spelled)).select("run_id", "ord", "source_name", "section", "outcome")
    told = json_sections(only(read, F.col("json").isNotNull()).select("run_id", F.col("json").alias("body"))).withColumn("outcome", F.lit(None).cast("string"))
    return mapped(plain.unionByName(told))


def lookups(answers: DataFrame) -> DataFrame:
    """run_id and lookup_status of each answer: SUCCESS if it gives offers and no issue, PARTIAL if it
    gives an offer or at least a word of not being found, else FAILED."""
    found = offers(answers).groupBy("run_id").agg(F.count_if(F.col("outcome") == "OK").alias("good"), F.count("*").alias("every"), F.count_if(F.col("outcome") == "NOT_FOUND").alias("absent"))
    status = F.when((F.col("good") > 0) & (F.col("good") == F.col("every")), "SUCCESS").when((F.col("good") > 0) | (F.col("absent") > 0), "PARTIAL").otherwise("FAILED")
    return answers.select("run_id").join(found, "run_id", "left").select("run_id", status.alias("lookup_status"))
