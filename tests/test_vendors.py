"""Vendors' answers: the sections' notation, each vendor's forms, and what breaks."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quoteloom.sources import vendors

MPN = "MTFDKBA480TFR-1BC1ZABYYR"
INGRAM = {"vendorPartNumber": MPN, "pricing": {"customerPrice": 1515.72, "retailPrice": 1800, "currencyCode": "usd "}, "availability": False, "Avl_Quantity": 0, "notes": ["it's", {"a": None}]}
CDW = {"manufacturerPartNumber": f" {MPN} ", "price": "1402.10", "currency": "USD", "stockStatus": "InStock", "quantity": 4}
SYNNEX = {"OnlineCheck": {"Header": {"CurrencyCode": "EUR", "SessionId": "FAKE"}, "Item": {"ManufacturerItemIdentifier": MPN, "UnitPriceAmount": "962.86", "AvailabilityTotal": "0", "Note": "No Returns accepted"}}}
NAMES = {"Ingram": INGRAM, "CDW": CDW, "Synnex EU": SYNNEX}


def body(values, start="", end="\n", how=repr):
    return "".join(f"{start}{name} Product: {value if isinstance(value, str) else how(value)}{end}" for name, value in values.items())


def asked(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "run_id long, body string")
    got = vendors.offers(rows).orderBy("run_id", "ord").collect()
    return [[r.asDict() for r in got if r.run_id == k] for k in range(len(bodies))]


def brief(rows):
    return [(r["source_name"], r["outcome"], r["price"] and str(r["price"].normalize()), r["currency_code"], r["availability"], r["quantity"], r["price_basis"], r["note_kind"]) for r in rows]


WANTED = [
    ("Ingram", "OK", "1515.72", "USD", "OUT_OF_STOCK", 0, "CUSTOMER_PRICE", None),
    ("CDW", "OK", "1402.1", "USD", "IN_STOCK", 4, "LIST_PRICE", None),
    ("Synnex EU", "OK", "962.86", "EUR", "OUT_OF_STOCK", 0, "LIST_PRICE", "NO_RETURNS"),
]


def test_text_and_json_give_the_same_offers(spark):
    entities = body(NAMES, "  <p>", "</p>\n", json.dumps).replace('"', "&quot;").replace(", &quot;", ",&#xA;&#xD;&quot;")
    junk = body(NAMES, "", "\nUnknown Product: {'price': 1}\n<div>CDW Product: {Not Found}\n")
    forms = [body(NAMES), body(NAMES, how=json.dumps), body(NAMES, "<p>", "</p>\r\n"), entities, junk, body(NAMES, how=lambda v: json.dumps(v, indent=2)), json.dumps(NAMES), json.dumps([{**v, "sourceName": f"the {k.lower()} source"} for k, v in NAMES.items()]), json.dumps(list(NAMES.values()))]
    for rows in asked(spark, forms):
        assert sorted(brief(rows)) == sorted(WANTED) and {r["explicit_mpn"] for r in rows} == {MPN}


def test_headings(spark):
    cases = {
        "first of a vendor counts": body({"CDW": CDW}) + "CDW Product: {Not Found}",
        "another word": "Acme Product: {}\nsome text",
        "case": "cdw Product: {Not Found}",
        "not at the start": "x CDW Product: {Not Found}",
        "no colon": "CDW Product {Not Found}",
        "no blank behind": "CDW Product:{Not Found}",
        "other tags": "<div>CDW Product: {Not Found}\n<p class=a>CDW Product: {Not Found}\n<p> CDW Product: {Not Found}\n<P>CDW Product: {Not Found}\n<p><span>CDW Product: {Not Found}\nx <p>CDW Product: {Not Found}",
        "at the end": "text\n\t CDW Product:",
        "marker": "CDW Product:  { Not \n Found } and more",
    }
    got = {name: [(r["source_name"], r["outcome"]) for r in rows] for name, rows in zip(cases, asked(spark, list(cases.values())), strict=True)}
    assert got.pop("first of a vendor counts") == [("CDW", "OK")]
    assert got.pop("at the end") == [("CDW", "MALFORMED_SECTION")] and got.pop("marker") == [("CDW", "NOT_FOUND")]
    assert not any(got.values())


@pytest.mark.parametrize(
    "text,want",
    [
        ("{'a': 1}", {"a": 1}), ('{"a": \'b"c\'}', {"a": 'b"c'}), ("{'a': 12.50,}", {"a": 12.5}), ("{'a': -.5, 'b': 007, 'c': 3.}", {"a": -0.5, "b": 7, "c": 3}),
        ("{'a': [True, false, None, null, [], {},],}", {"a": [True, False, None, None, [], {}]}), ("{}", {}), (r"{'a': 'x\n\'\"\\é\t'}", {"a": "x\n'\"\\é\t"}),
        ("{'a': 1} <b>{'a': 2}", {"a": 1}), ("{'a\nb': 1}", {"a\nb": 1}), ("{'a': 1, 'a': 2}", None), ("{a: 1}", None), ("{1: 1}", None), ("{'a': 1.2.3}", None), ("{'a': -}", None), ("{'a': 'x}", None),
        (r"{'a': '\x41'}", None), (r"{'a': '\u12g4'}", None), ("{'a': 1 + 1}", None), ("{'a': __import__('os').system('x')}", None), ("{'a': open}", None), ("{,}", None), ("{'a':,}", None), ("{'a': 1,,}", None),
        ("{'a': 1 'b': 2}", None), ("{'a' 1}", None), ("{'a': 1]", None), ("[1]", None), ("'x'", None), ("{'a': &nbsp;1}", None), ("{'a': 1", None), ("{'a': " + "[" * 31 + "]" * 31 + "}", "deep"),
        ("{'a': " + "[" * 32 + "]" * 32 + "}", None), ("{'a': [" + "1," * 256 + "]}", "many"), ("{'a': [" + "1," * 257 + "]}", None), ("{'a': 1e5}", None), ("{'a': NaN}", None),
    ],
)
def test_notation(spark, text, want):
    row = spark.createDataFrame([(vendors.literal_json(text),)], "t string")
    got = row.select(F.try_parse_json("t").alias("v")).select(F.to_json("v").alias("j"), F.schema_of_variant("v").startswith("OBJECT").alias("whole")).first()
    if want in ("deep", "many"):
        assert got.whole
    elif want is None:
        assert not got.whole
    else:
        assert json.loads(got.j) == want


def single(spark, name, cases):
    rows = asked(spark, [body({name: c}) for c in cases])
    return [brief(r)[0][1:] for r in rows]


def test_ingram(spark):
    flat = {"vendorPartNumber": MPN, "customerPrice": 10, "currency": "USD"}
    nested = lambda **k: {"vendorPartNumber": MPN, "pricing": {"retailPrice": Decimal("9.5"), "currencyCode": "USD"}, **k}
    show = lambda v: repr(v).replace("Decimal('9.5')", "9.5")
    cases = [
        flat | {"quantity": 3}, flat | {"quantity": 0}, flat, flat | {"available": True, "quantity": 0}, flat | {"available": False, "quantity": 0}, flat | {"available": False}, flat | {"available": True}, flat | {"quantity": "3"}, flat | {"quantity": -1},
        flat | {"customerPrice": None, "retailPrice": 5}, flat | {"customerPrice": True}, flat | {"customerPrice": -1}, flat | {"customerPrice": "NaN"}, {"vendorPartNumber": MPN, "retailPrice": 5, "currency": "USD"}, {"vendorPartNumber": MPN, "currency": "USD"},
        flat | {"currency": " "}, flat | {"vendorPartNumber": None}, flat | {"vendorPartNumber": " "}, flat | {"vendorPartNumber": 7}, {"NotFound": True}, {"Not Found": "yes"}, {"notFound": 0}, flat | {"pricing": None}, flat | {"pricing": [1]},
        nested(availability=True, Avl_Quantity=2), nested(availability=True, Avl_Quantity=0), nested(availability={"available": False, "Avl_Quantity": 0}), nested(Avl_Quantity=7), nested(availability="yes"), nested(pricing={"customerPrice": None, "retailPrice": 1, "currencyCode": "USD"}),
    ]
    got = single(spark, "Ingram", [show(c) for c in cases])
    stock = [("IN_STOCK", 3), ("OUT_OF_STOCK", 0), ("UNKNOWN", None), ("UNKNOWN", 0), ("OUT_OF_STOCK", 0), ("UNKNOWN", None), ("IN_STOCK", None), ("UNKNOWN", None), ("UNKNOWN", None)]
    assert [g[3:5] for g in got[:9]] == stock and {g[0] for g in got[:9]} == {"OK"}
    bad = "MALFORMED_SECTION"
    assert [g[0] for g in got[9:24]] == [bad, bad, bad, bad, "OK", bad, bad, "MISSING_EXPLICIT_MPN", "MISSING_EXPLICIT_MPN", bad, "NOT_FOUND", "NOT_FOUND", "MISSING_EXPLICIT_MPN", "OK", bad]
    assert got[13][5] == "RETAIL_PRICE_FALLBACK"
    assert [g[3:5] for g in got[24:29]] == [("IN_STOCK", 2), ("UNKNOWN", 0), ("OUT_OF_STOCK", 0), ("IN_STOCK", 7), ("UNKNOWN", None)] and got[29][0] == bad


def test_cdw(spark):
    base = {"manufacturerPartNumber": MPN, "price": 12, "currencyCode": None, "currency": "eur"}
    cases = [
        base | {"stockStatus": "InStock"}, base | {"stockStatus": "InStock", "quantity": 0}, base | {"stockStatus": "OutOfStock", "Avl_Quantity": 3, "quantity": 0}, base | {"stockStatus": "OutOfStock"}, base | {"quantity": 5}, base, base | {"stockStatus": 5, "quantity": 0},
        base | {"inventoryStatus": {"stockStatus": "InStock", "Avl_Quantity": 2}}, base | {"inventoryStatus": {"Avl_Quantity": 2}}, base | {"inventoryStatus": "x", "quantity": 2}, base | {"price": "x"}, base | {"currency": 3}, base | {"manufacturerPartNumber": {}},
    ]
    got = single(spark, "CDW", cases)
    assert [g[3:5] for g in got[:10]] == [("IN_STOCK", None), ("UNKNOWN", 0), ("UNKNOWN", 3), ("OUT_OF_STOCK", None), ("IN_STOCK", 5), ("UNKNOWN", None), ("OUT_OF_STOCK", 0), ("IN_STOCK", 2), ("UNKNOWN", 2), ("UNKNOWN", 2)]
    assert {g[2] for g in got[:10]} == {"EUR"} and [g[0] for g in got[10:]] == ["MALFORMED_SECTION"] * 3


def test_synnex(spark):
    flat = {"ManufacturerItemIdentifier": MPN, "UnitPriceAmount": Decimal("962.86"), "CurrencyCode": "EUR"}
    item = lambda **k: {"OnlineCheck": {"Header": {"CurrencyCode": "EUR"}, "Item": {"ManufacturerItemIdentifier": MPN, "UnitPriceAmount": 5, **k}}}
    cases = [
        flat | {"AvailabilityTotal": 3}, flat | {"AvailabilityTotal": "3"}, flat | {"AvailabilityTotal": 0, "Note": "whatever"}, flat | {"Note": "Item NOT MAINTAINED here"}, flat | {"notMaintained": True}, flat | {"currency": " "}, flat | {"ManufacturerItemIdentifier": None},
        flat | {"CurrencyCode": None, "ManufacturerItemIdentifier": None}, item(AvailabilityTotal="12"), item(AvailabilityTotal="-1"), item(AvailabilityTotal="1.0"), item(AvailabilityTotal=4, Note="no returns"), item(Note="not maintained", UnitPriceAmount=None),
        {"OnlineCheck": []}, {"OnlineCheck": {"Header": {"CurrencyCode": "EUR"}}}, {"OnlineCheck": {"Item": {"ManufacturerItemIdentifier": None}}}, item(ManufacturerItemIdentifier=None),
    ]
    got = single(spark, "Synnex EU", [repr(c).replace("Decimal('962.86')", "962.86") for c in cases])
    bad, gone, nameless = "MALFORMED_SECTION", "NOT_FOUND", "MISSING_EXPLICIT_MPN"
    assert [g[0] for g in got] == ["OK", "OK", "OK", gone, gone, bad, nameless, bad, "OK", "OK", "OK", "OK", gone, bad, bad, bad, nameless]
    assert [got[k][3:5] for k in (0, 1, 2, 8, 9, 10, 11)] == [("IN_STOCK", 3), ("UNKNOWN", None), ("OUT_OF_STOCK", 0), ("IN_STOCK", 12), ("UNKNOWN", None), ("UNKNOWN", None), ("IN_STOCK", 4)] and got[11][6] == "NO_RETURNS"


def test_lookups(spark):
    bodies = [body(NAMES), body({"CDW": CDW, "Ingram": "{Not Found}"}), body({"CDW": "{Not Found}", "Ingram": "oops"}), body({"CDW": "oops"}), "nothing", "[1, 2]", "{}", '"text"', json.dumps({"CDW": {"Not Found": True}}), "x" * vendors.MOST_BYTES + "y", None, "", json.dumps({"other": CDW, "x": 1}), json.dumps([{"a": 1}])]
    rows = spark.createDataFrame(list(enumerate(bodies)), "run_id long, body string")
    got = {r.run_id: r.lookup_status for r in vendors.lookups(rows).collect()}
    want = ["SUCCESS", "PARTIAL", "PARTIAL", "FAILED", "FAILED", "FAILED", "FAILED", "FAILED", "PARTIAL", "FAILED", "FAILED", "FAILED", "SUCCESS", "FAILED"]
    assert [got[k] for k in range(len(bodies))] == want
    raw = spark.createDataFrame([(1, b"CDW Product: {Not Found}\xff")], "run_id long, body binary")
    assert vendors.lookups(raw).first().lookup_status == "FAILED"
    assert [r["source_name"] for r in asked(spark, [json.dumps([{"a": 1}])])[0]] == ["Unknown"]


def test_json_is_one_value_to_its_end(spark):
    texts = ["{}", " [1] ", "1", '"x"', "null", "{}{}", "{} x", "{}]", "1,2", "", " ", '{},["a"', '{},5]', "{", "[1]]", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vendors.whole_json(F.col("t")).isNotNull().alias("whole"))
    assert [r.t for r in rows.collect() if r.whole] == texts[:5]
