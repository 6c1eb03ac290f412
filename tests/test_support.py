"""Records of support pages: where they are looked for, and what a broken one does."""

import json

import pytest

from quoteloom.operators import comparables
from quoteloom.sources import support

BS = chr(92)


def script(records, name="supportSpecsData", escape=True):
    text = records if isinstance(records, str) else json.dumps(records)
    if escape:
        text = text.replace(BS, BS * 2).replace("'", BS + "'")
    return f"<script>\nvar {name} = JSON.parse('{text}');\n</script>"


def rows(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


def found(spark, *pages):
    got = support.candidates(support.records(rows(spark, *pages), "page_id"), "page_id").orderBy("page_id", *support.PLACE)
    return [(r.page_id, r.mpn, r.title, r.raw_reference) for r in got.collect()]


def feature(label, value):
    return {"title": label, "value": value}


def test_only_the_variable_itself_is_read(spark):
    record = [{"skuNumber": "A1", "title": "Drive"}]
    pages = [
        "", "   ", "some text supportSpecsData", script(record, "otherData"), script(record, "supportSpecsDataX"), script(record).replace("var ", "let "), '<script type="application/ld+json">{"skuNumber":"A1"}</script>', script(record).replace("</script>", ""),
        "<p>" + script(record)[8:] + "</p>", script(record).replace("JSON.parse(", "JSON.stringify("), script(record).replace("')", "'+x)"), script("not valid json"), script({"skuNumber": "A1"}), script([5, None, "x", {}, {"skuNumber": 7}, {"skuNumber": "  "}, {"title": "A1"}]),
    ]
    assert found(spark, *pages) == []


def test_records_and_their_places(spark):
    other = script([{"skuNumber": "NO"}], "otherData")[9:-10]
    mine = script([{"title": "x"}, {"skuNumber": " A1 ", "title": " Nytro® <b>"}, {"skuNumber": "A2", "title": 5}])[9:-10]
    page = f"<SCRIPT a='b'>{other}{mine}{script('[oops')[9:-10]}{script([{'skuNumber': 'B'}])[9:-10]}</SCRIPT><script></script>" + script([{"skuNumber": "C", "title": "it's \\ \"so\"\n"}])
    place = "embedded_json[{}][{}].record[{}]".format
    assert found(spark, page) == [(0, " A1 ", " Nytro® <b>", place(0, 0, 1)), (0, "A2", None, place(0, 0, 2)), (0, "B", None, place(0, 2, 0)), (0, "C", "it's \\ \"so\"\n", place(2, 0, 0))]


def test_escapes(spark):
    twice = script(f'[{{"skuNumber":"E","title":"Product{BS * 2}u003csup{BS * 2}u003e{BS * 2}u00ae"}}]', escape=False)
    literal = script('[{"skuNumber":"L","title":"Öffensives ärger"}]', escape=False)
    once = script(f'[{{{BS}u0022skuNumber":"O","title":"a{BS}q{BS}/"}}]', escape=False)
    assert [r[1:3] for r in found(spark, twice, literal)] == [("E", "Product<sup>®"), ("L", "Öffensives ärger")]
    assert support.payloads(once)[0]["text"] == f'[{{"skuNumber":"O","title":"a{BS}q{BS}/"}}]'
    assert support.payloads("<script>var supportSpecsData = JSON.parse('open" + BS) == [] and support.payloads(None) == []


def test_features_of_exactly_the_product(spark):
    records = [
        {"skuNumber": "A1", "features": [feature("Interface", "NVMe"), feature(" form \n FACTOR", " 2.5-inch "), feature("Form Factor", " "), feature("Form Factor", 5), feature(7, "x"), "x", feature("Form Factor", "M.2")]},
        {"skuNumber": "A1 ", "features": [feature("Form Factor", "E3.S")]},
        {"skuNumber": "a1", "features": [feature("Form Factor", "E3.S")]},
        {"skuNumber": "A2", "features": "none"},
    ]
    products = spark.createDataFrame([(1, "A1"), (2, "A2")], "product_id long, mpn string")
    got = support.specifications(support.records(rows(spark, script(records)), "page_id"), products, "page_id").orderBy("raw_reference").collect()
    assert [(r.product_id, r.definition_key, r.raw_value, r.raw_reference) for r in got] == [(1, "physical_form_factor", v, f"embedded_json[0][0].record[0].features[{k}]") for k, v in ((1, " 2.5-inch "), (6, "M.2"))]


def test_datasheet_links(spark):
    records = [{"skuNumber": "A", "datasheet": "/a.pdf"}, {"skuNumber": "B", "datasheet": " "}, {"skuNumber": "C"}, {"skuNumber": "D", "datasheet": "/d"}, {"skuNumber": "E", "datasheet": 5}]
    page = script(records) + script([{"skuNumber": "D", "datasheet": "/d"}, {"skuNumber": "a", "datasheet": "/x"}])
    got = {r.sku: (r.outcome, r.path) for r in support.datasheet_links(support.records(rows(spark, page), "page_id"), "page_id").collect()}
    assert got == {"A": ("LINK", "/a.pdf"), "B": ("ABSENT", None), "C": ("ABSENT", None), "D": ("AMBIGUOUS", None), "E": ("ABSENT", None), "a": ("LINK", "/x")}


def test_comparables(spark):
    records = [
        {"skuNumber": "T-1", "features": [feature("Form Factor", "M.2")]},
        {"skuNumber": "A 1", "title": "first", "features": [feature("Form Factor", "m.2")]},
        {"skuNumber": "a-1", "title": "again"},
        {"skuNumber": "B", "features": [feature("Form Factor", "2.5 in")]},
        {"skuNumber": "D"},
        {"skuNumber": "--"},
    ]
    pages = rows(spark, script(records), script([{"skuNumber": "A-1"}, {"skuNumber": "t-1"}]))
    targets = spark.createDataFrame([(0, "T-1"), (1, "T-1")], "page_id long, target_mpn string")
    got = {r.mpn_key: (r.mpn, r.title, r.evidence) for r in comparables.discovered(pages, targets).collect()}
    assert got == {"A-1": ("A 1", "first", 3), "B": ("B", None, 1), "D": ("D", None, 1)}
    marks = comparables.assessed(support.candidates(support.records(pages, "page_id"), "page_id"), targets).groupBy("disposition").count().collect()
    assert {r.disposition: r["count"] for r in marks} == {"TARGET_SELF": 2, "NO_KEY": 1, "CANDIDATE": 5}
    alike = {r.candidate_id: (r.scored, r.observed, r.evidence_weighted) for r in comparables.compared(pages, targets).collect()}
    assert alike == {"A 1": (1, 1.0, round(1 / 12, 6)), "B": (1, 0.0, 0.0), "D": (0, None, 0.0)}
    every = comparables.researched(pages, spark.createDataFrame([("T-1", "T-1")], "product_id string, mpn string"))
    assert {r.definition_key: r.state for r in every.collect()}.pop("physical_form_factor") == "VERIFIED" and every.count() == 12


@pytest.mark.parametrize("n", [1, 4])
def test_first_seen_does_not_depend_on_partitions(spark, n):
    pages = rows(spark, *(script([{"skuNumber": "X" if k else "x", "title": str(k)}]) for k in range(8))).repartition(n)
    targets = spark.createDataFrame([(k, "T") for k in range(8)], "page_id long, target_mpn string")
    assert [(r.mpn, r.title, r.evidence) for r in comparables.discovered(pages, targets).collect()] == [("x", "0", 8)]
