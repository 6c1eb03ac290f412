"""Listings of pages, prices and review actions on hand-made cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quoteloom.functions import commerce, price
from quoteloom.functions import part_number as pn
from quoteloom.functions.text import SPACES, strip
from quoteloom.operators import logs
from quoteloom.operators.extract import listings


def page(*blocks, body="", head=""):
    scripts = "".join(f'<script type="application/ld+json">{json.dumps(b)}</script>' for b in blocks)
    return f"<html><head>{head}{scripts}</head><body>{body}</body></html>"


PRODUCT = {"@type": "Product", "name": "Drive", "sku": "S1", "brand": {"@type": "Brand", "name": "Acme"}, "offers": {"@type": "Offer", "price": 1055.850, "priceCurrency": "USD"}}


def test_structured_offers():
    (one,) = listings(page(PRODUCT).replace("1055.85", "1055.850"))
    assert (one["price_text"], one["brand_text"], one["condition_text"]) == ("1055.850", "Acme", None)
    many = PRODUCT | {"itemCondition": "New", "offers": [{"@type": "Offer", "price": "1"}, {"priceCurrency": "EUR"}, {"url": "x"}, {"@type": "AggregateOffer", "lowPrice": "2", "price": "9"}]}
    found = listings(page(many))
    # an object that is neither typed nor priced is no offer; the product's own condition is not the offer's
    assert [(x["price_text"], x["currency_text"], x["condition_text"]) for x in found] == [("1", None, None), (None, "EUR", None), (None, None, None)]
    assert [json.loads(x["raw_reference"])["offers"] for x in found] == [many["offers"][k] for k in (0, 1, 3)]
    nested = PRODUCT | {"offers": {"@type": "https://schema.org/AggregateOffer", "lowPrice": "1", "offers": [{"@type": "Offer", "price": "5"}, {"@type": "Offer", "price": "6"}]}}
    assert [x["price_text"] for x in listings(page(nested))] == ["5", "6"]
    assert len(listings(page({"@graph": [{"@type": ["Thing", "ProductModel"], "name": "x"}, {"@type": "BreadcrumbList"}]}))) == 1
    assert listings(page({"@type": "BreadcrumbList"})) == [] == listings(None) == listings("<script type='application/ld+json'>{broken</script>")


def test_meta_tags():
    meta = lambda **kv: "".join(f'<meta property="{k}" content="{v}">' for k, v in kv.items())
    (one,) = listings(page(head='<meta name="mpn" content="A-1"><meta name="priceCurrency" content="USD"><meta property="og:title" content="T"><meta name="og:price:amount" content="7"><meta name="price" content="8"/>'))
    assert (one["mpn_text"], one["currency_text"], one["product_title"], one["price_text"], one["extraction_method"]) == ("A-1", "USD", "T", "7", "META")
    assert json.loads(one["raw_reference"]) == {"mpn_text": "A-1", "currency_text": "USD", "product_title": "T", "price_text": "7"}
    assert listings(page(head=meta(**{"product:retailer_part_no": "P9"})))[0]["mpn_text"] == "P9"
    assert listings(page(head=meta(**{"og:title": "only a title"}))) == [] == listings(page(head=meta(**{"product:mfr_part_no": "P9"})))
    assert listings(page(head='<meta name="pricecurrency" content="USD"><meta name="sku" content="s">'))[0]["currency_text"] is None
    assert listings(page(PRODUCT, head='<meta name="mpn" content="A-1">'))[0]["mpn_text"] is None  # meta only without structured data


VISIBLE = {
    "<p>Model #: MZ-7L3 Item #: 55</p>": "MZ-7L3",
    "<table><tr><th>MPN</th><td>AB/12</td></tr></table>": "AB/12",
    "<dl><dt>Manufacturer Part Number:</dt><dd>X1</dd></dl>": "X1",
    "<div><strong>Mfr Part #</strong><span>Q-2</span></div>": "Q-2",
    "<p>MPN: <b>X5</b></p>": "X5",
    "<p>MPN: X1</p><p>Model Number: x1</p>": "X1",
    "<p>MPN: X1</p><p>MPN: X2</p>": None,  # two values
    "<p>Part Number: X1</p>": None,
    "<p>SKU: X1</p>": None,
    "<div><p>MPN</p></div><div><p>X1</p></div>": None,  # other parent
    "<div><p>MPN</p><p>X1</p></div>": None,  # not such a pair of tags
    "<p>MPN: two words</p>": None,
    "<script>MPN: X1</script><style>MPN: X1</style>": None,
    "<div>MPN: X1<p>more text of the page</p></div>": None,  # an element with blocks inside
    f"<p>MPN: {'X' * 300}</p>": None,
}


@pytest.mark.parametrize("body,mpn", VISIBLE.items())
def test_visible_part_numbers(body, mpn):
    (one,) = listings(page(PRODUCT, body=body))
    assert (one["mpn_text"], one["extraction_method"]) == (mpn, "JSON_LD_WITH_VISIBLE_MPN" if mpn else "JSON_LD")


def test_visible_part_number_of_several_listings():
    body = "<p>MPN: X1</p>"
    two = PRODUCT | {"offers": [{"price": "1"}, {"price": "2"}]}
    assert [x["mpn_text"] for x in listings(page(two, body=body))] == ["X1", "X1"]
    assert [x["mpn_text"] for x in listings(page(PRODUCT, PRODUCT | {"name": "Other"}, body=body))] == [None, None]
    assert [x["mpn_text"] for x in listings(page(PRODUCT | {"mpn": "Y"}, body=body))] == ["Y"]
    assert [x["mpn_text"] for x in listings(page({"@type": "Product", "offers": {"price": "1"}}, body=body))] == [None]
    assert listings(page(body=body)) == []
    meta = listings(page(head='<meta name="sku" content="s">', body=body))
    assert [(x["mpn_text"], x["extraction_method"]) for x in meta] == [("X1", "META_WITH_VISIBLE_MPN")]


PRICES = [
    ("$1,055.85", "1055.85", None, None), ("€12", "12", "EUR", None), ("12 £", "12", "GBP", None), ("usd 7", "7", "USD", None), ("7 Eur", "7", "EUR", None), (" 1,234,567 ", "1234567", None, None),
    ("$ 5", "5", None, None), ("USD\t5", "5", "USD", None), ("5USD", None, None, "INVALID_PRICE"), ("USD5", None, None, "INVALID_PRICE"), ("EUR 12 USD", None, None, "AMBIGUOUS_PRICE"), ("$5 USD", None, None, "AMBIGUOUS_PRICE"),
    ("1,23", None, None, "INVALID_PRICE"), ("1234,567", None, None, "INVALID_PRICE"), ("10 - 20", None, None, "AMBIGUOUS_PRICE"), ("from 5", None, None, "AMBIGUOUS_PRICE"), ("save 5", None, None, "AMBIGUOUS_PRICE"),
    ("5/mo", None, None, "AMBIGUOUS_PRICE"), ("call us", None, None, "INVALID_PRICE"), ("", None, None, "INVALID_PRICE"), ("$", None, None, "INVALID_PRICE"), ("-5", None, None, "INVALID_PRICE"), ("5.", None, None, "INVALID_PRICE"),
    (".5", None, None, "INVALID_PRICE"), ("5.50", "5.50", None, None), (None, None, None, None), ("USD", None, None, "INVALID_PRICE"), (" 5 ", "5", None, None), ("¥100", "100", None, None), ("XYZ 5", None, None, "INVALID_PRICE"),
]


def test_prices(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(PRICES)], "k int, t string")
    got = {r.k: r.p for r in price.with_price(rows, "t", "p").collect()}
    for k, (text, amount, code, issue) in enumerate(PRICES):
        assert (None if got[k].amount is None else float(got[k].amount), got[k].currency, got[k].issue) == (amount and float(amount), code, issue), text


def test_texts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(SPACES + "ab-") for _ in range(rng.randrange(8))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"), pn.key(F.col("t")).alias("key"))
    for r in rows.collect():
        assert r.s == r.t.strip(SPACES)
    terms = spark.createDataFrame([("HTTPS://Schema.org/InStock",), ("schema.org/ OutOfStock ",), (" sold out",), ("http://x/InStock",), (None,)], "t string")
    assert [r[0] for r in terms.select(commerce.availability(F.col("t"))).collect()] == ["IN_STOCK", "OUT_OF_STOCK", "OUT_OF_STOCK", "UNKNOWN", "UNKNOWN"]
    labels = spark.createDataFrame([("MPN: a-1 ",), ("mpn:b",), ("mpnx",), ("",)], "t string")
    assert [r[0] for r in labels.select(pn.without_label(F.col("t"))).collect()] == ["a-1", "b", "mpnx", ""]


def test_review_actions(spark):
    """Every sequence of up to four actions against a plain state."""
    from itertools import product

    asks = {"confirm": "CONFIRMED", "reject": "REJECTED", "remove": "REJECTED", "undo": "UNREVIEWED"}
    rows, want = [], {}
    for c, actions in enumerate(a for n in range(1, 5) for a in product(asks, repeat=n)):
        state = "UNREVIEWED"
        for k, action in enumerate(actions):
            before = state
            if asks[action] == state:
                outcome = "NO_CHANGE"
            elif state == "UNREVIEWED" or action in ("remove", "undo"):
                outcome, state = "APPLIED", asks[action]
            else:
                outcome = "CONFLICT"
            rows.append((c, k, action))
            want[c, k] = (before, outcome, state)
    got = logs.review_events(spark.createDataFrame(rows, "c int, k int, action string"), ["c"], ["k"]).collect()
    assert {(r.c, r.k): (r.state_before, r.outcome, r.state_after) for r in got} == want


def test_prices_with_other_blanks_and_several_points(spark):
    cases = {"EUR 12": ("EUR", 12), "$ 5": (None, 5), "12 €": ("EUR", 12), "5 USD": ("USD", 5), "1.234.567 €": "AMBIGUOUS_PRICE", "USD12": "INVALID_PRICE", "1,23": "INVALID_PRICE", "7": (None, 7), "€ 7 EUR": "AMBIGUOUS_PRICE"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.p for r in price.with_price(rows, "t", "p").collect()}
    for text, want in cases.items():
        p = got[text]
        assert (p.issue if isinstance(want, str) else (p.currency, p.amount)) == want, text


def test_spec_readings(spark):
    from quoteloom.functions.specs import normalize

    cases = {
        ("capacity", "7.68 TB"): 7.68, ("capacity", "960gb"): 0.96, ("capacity", "1,920 GB"): 1.92, ("capacity", "1,92 TB"): "UNRECOGNIZED_FORMAT", ("capacity", "-1 TB"): "OUT_OF_RANGE_OR_NON_POSITIVE", ("capacity", "1 - 2 TB"): "AMBIGUOUS_VALUE",
        ("capacity", "5 T B"): "UNRECOGNIZED_FORMAT", ("capacity", "4 TiB"): "UNSUPPORTED_UNIT", ("sequential_read", "6.8 gb/s"): 6800, ("sequential_write", "500 MB/s"): 500, ("random_read_iops", "1,000 K  IOPS"): 1000000, ("random_write_iops", "1.1M IOPS"): 1100000,
        ("random_write_iops", "90KIOPS"): 90000, ("random_read_iops", "90 k IOPS"): "UNRECOGNIZED_FORMAT", ("random_read_iops", "90000"): "UNRECOGNIZED_FORMAT", ("endurance_dwpd", "1.3"): 1.3, ("endurance_dwpd", "3 DWPD"): 3, ("endurance_dwpd", "0"): "OUT_OF_RANGE_OR_NON_POSITIVE",
        ("sequential_read", ""): "MISSING_OR_EMPTY_VALUE", ("capacity", "up to 8 TB"): "AMBIGUOUS_VALUE", ("capacity", "8"): "UNRECOGNIZED_FORMAT",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases], "definition_key string, raw_value string")
    for r in normalize(rows).collect():
        want = cases[r.definition_key, r.raw_value]
        assert (r.issue or float(r.value_dec)) == want, r


def test_packaging_phrases():
    from quoteloom.operators.extract import cues

    cases = {
        "10-unit factory  pack": [("TRAY_OR_FACTORY_PACK", 10, None)], "4 unit bundle": [("BUNDLE", None, "BUNDLE_WITHOUT_CONTENTS")], "OEM tray of 20.": [("TRAY_OR_FACTORY_PACK", 20, None)], "pack of 2TB drives": [("PACK_QUANTITY", None, "CAPACITY_ATTACHED_QUANTITY")],
        "pack of 05": [("PACK_QUANTITY", None, "NON_CANONICAL_QUANTITY")], "pack of 2.5": [("PACK_QUANTITY", None, "NON_CANONICAL_QUANTITY")], "5 - pack": [("PACK_QUANTITY", 5, None)], "007-pack": [("PACK_QUANTITY", None, "NON_CANONICAL_QUANTITY")], "2.5 pack": [("PACK_QUANTITY", None, "PACK_WITHOUT_COUNT")],
        "bundle (a + b)": [("BUNDLE", None, None)], "a bundle": [("BUNDLE", None, "BUNDLE_WITHOUT_CONTENTS")], "1 unit": [("SINGLE_UNIT", None, None)], "single-unit tray": [("SINGLE_UNIT", None, None), ("TRAY_OR_FACTORY_PACK", None, None)], "4packs, unpack, tray_1": [], "": [],
    }
    for text, want in cases.items():
        assert [(c["kind"], c["quantity"], c["reason"]) for c in cues(text)] == want, text


def test_fallbacks(spark):
    from quoteloom.operators import logs

    rows = [(k, role, o) for k, (one, two) in enumerate([("SUCCESS", "SUCCESS"), ("DNS_ERROR", "SUCCESS"), ("SERVER_ERROR", "SUCCESS"), ("SCHEMA_INVALID", "TIMEOUT"), ("INVALID_RESPONSE", "SUCCESS")]) for role, o in (("PRIMARY", one), ("FALLBACK", two))]
    got = {r.case_id: r.answered_by for r in logs.routed(spark.createDataFrame(rows, "case_id long, role string, outcome string")).collect()}
    assert got == {0: "PRIMARY", 1: "FALLBACK", 2: "NONE", 3: "NONE", 4: "FALLBACK"}


def test_newest_observation_however_rows_lie(spark):
    from datetime import date

    from quoteloom.operators.rates import reusable

    day = date(2024, 1, 26)
    rows = [(k, "f", day, day, day, ["USD", "GBP"] if k % 2 else ["USD"]) for k in range(40)]
    schema = "observation_id long, feed_id string, observed_on date, proven_on date, asked_on date, codes array<string>"
    for n in (1, 5):
        got = reusable(spark.createDataFrame(rows, schema).repartition(n), ["GBP"]).collect()
        assert [(r.observation_id, r.outcome) for r in got] == [(39, "REUSABLE")]


def test_public_addresses(spark):
    from quoteloom.functions.quote import public_address

    cases = {
        "8.8.8.8": True, "10.0.0.1": False, "2606:4700::1111": True, "::1": False, "::": False, "::ffff:127.0.0.1": False, "::FFFF:8.8.8.8": True, "::ffff:808:808": True, "2002:7f00:1::": False, "2002:808:808::1": True, "2001:db8::1": False, "2001:db9::1": True,
        "2001::1": False, "2001:1::1": True, "2001:1::3": False, "2001:3::1": True, "2001:4:112::1": True, "2001:4:113::1": False, "2001:20::1": True, "2001:30::1": True, "2001:40::1": False, "3fff:fff::1": False, "3fff:1000::1": True, "fe80::1": False, "fc00::1": False, "fd12::1": False,
        "fec0::1": True, "ff02::1": False, "64:ff9b::808:808": False, "100::1": False, "4000::1": False, "1:2:3:4:5:6:7": None, "2606::1::2": None, "2606:1:2:3:4:5:6:7:8": None, "2606:::1": None, "2606::g": None, "::ffff:300.1.1.1": None, "2606:1:2:3:4:5:6:7": True, "::2606:1:2:3:4:5:6:7": None, "x": None, "": None,
    }
    rows = spark.createDataFrame([(a,) for a in cases], "a string").select("a", public_address(F.col("a")).alias("p"))
    assert {r.a: r.p for r in rows.collect()} == cases


def test_links_by_place(spark):
    from quoteloom.operators.quotes import with_links

    rows = [(1, 10, "a.example"), (1, 20, "b.example"), (2, 1, "a.example"), (3, 1, "a.example"), (3, 2, "a.example"), (4, 1, "a.example")]
    found = [(1, 3, "https://A.example/x"), (1, 5, "https://a.example/y"), (2, 1, "https://a.example/"), (2, 2, "https://a.example/"), (3, 1, "javascript:alert(1)"), (3, 2, None), (5, 1, "https://a.example/")]
    got = with_links(spark.createDataFrame(rows, "run_id long, ord long, source string"), spark.createDataFrame(found, "run_id long, ord long, source_url string")).collect()
    assert {(r.run_id, r.ord): r.link for r in got} == {(1, 10): "https://A.example/x", (1, 20): None, (2, 1): None, (3, 1): None, (3, 2): None, (4, 1): None}


def test_site_local_addresses_are_not_routable_in_the_query(spark, tmp_path):
    from quoteloom.plans.published import routable_addresses6

    rows = [(4, 704), (12, 767), (20, 703), (28, 768), (8, 100)]  # fec0::, feff::, febf::, ff00:: and 2064::
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id: r.public for r in routable_addresses6(spark, str(tmp_path)).collect()} == {4: False, 12: False, 20: False, 28: False, 8: True}


def test_partition_law_takes_one_pass(spark):
    from quoteloom.plans.market import partition_law

    plan = partition_law(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # one listing view: two tables
