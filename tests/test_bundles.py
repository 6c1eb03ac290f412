"""Bundles: what a text says is inside, when two are the same, and what the versions of the rules make of it."""

import pytest
from pyspark.sql import functions as F

from quoteloom.operators import bundles

CASES = {
    "bundle": (None, "ABSENT"), "Bundle of 3": (None, "ABSENT"), "10-unit bundle": (None, "ABSENT"), "": (None, "ABSENT"), "bundle:": (None, "ABSENT"), "bundle ( )": (None, "ABSENT"), "bundle: complete list": (None, "ABSENT"), "All included": (None, "ABSENT"),
    "bundle: SSD + cable": ("SSD + cable", "SYNTACTICALLY_VALID"), "BUNDLE (SSD + cable)": ("SSD + cable", "SYNTACTICALLY_VALID"), "bundle of 2 (SSD, cable)": ("SSD, cable", "SYNTACTICALLY_VALID"), "4 - unit bundle: a": ("a", "SYNTACTICALLY_VALID"), "SSD and cable": ("SSD and cable", "SYNTACTICALLY_VALID"),
    "bundle (SSD + cable": ("SSD + cable", "PARTIAL"), "bundle: SSD +": ("SSD +", "PARTIAL"), "bundle: SSD, etc.": ("SSD, etc.", "PARTIAL"), "bundle: SSD and more": ("SSD and more", "PARTIAL"), "bundle: SSD + more": ("SSD + more", "PARTIAL"), "bundle: SSD…": ("SSD…", "PARTIAL"), "a, 2 x": ("a, 2 x", "PARTIAL"), "a, 2x ": ("a, 2x", "PARTIAL"),
    "SSD among others, complete list": ("SSD among others, complete list", "PARTIAL"), "bundles of joy": ("bundles of joy", "SYNTACTICALLY_VALID"), "bundle of 3 drives": ("bundle of 3 drives", "SYNTACTICALLY_VALID"),
    "bundle: SSD + cable, complete list": ("SSD + cable", "ESTABLISHED"), "bundle (SSD and cable; Full Contents)": ("SSD and cable", "ESTABLISHED"), "SSD + nothing else included": ("SSD", "ESTABLISHED"), "SSD and all included": ("SSD", "ESTABLISHED"), "SSD (complete list": ("SSD", "ESTABLISHED"),
    "SSD +, complete list": ("SSD +, complete list", "PARTIAL"), "SSD complete list": ("SSD complete list", "SYNTACTICALLY_VALID"), "SSD,complete list": ("SSD,complete list", "SYNTACTICALLY_VALID"), "band all included": ("band all included", "SYNTACTICALLY_VALID"), "a+ complete list": ("a+ complete list", "SYNTACTICALLY_VALID"),
}


def test_clauses_and_states(spark):
    rows = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "t string")
    got = {r.t: (r.c.clause, r.c.state) for r in bundles.composition(rows, "t", "c").collect()}
    assert got.pop(None) == (None, "ABSENT")
    assert got == CASES
    said = bundles.composition(spark.createDataFrame([("SSD and  all included ",), ("SSD",)], "t string"), "t", "c").select("c.statement").collect()
    assert [r.statement for r in said] == ["and  all included", None]


ITEMS = {
    "SSD + 2x Cable": [(1, "ssd"), (2, "cable")], "cable & SSD": [(1, "cable"), (1, "ssd")], "2× screws,960GB SSD": [(1, "960gb ssd"), (2, "screws")], "2 × screws": None, "10  long   cables and a": [(1, "a"), (10, "long cables")], "U.2 bracket-kit_1": [(1, "u.2 bracket-kit_1")],
    "sand and band": [(1, "band"), (1, "sand")], "04x RAM": None, "0 cables": None, "100000 x a": None, "a + ": None, "a,,b": None, "a (new)": None, "2x": None, "2x + a": None, "é": None, "-a": None, "a.": None, "": None,
}


def test_items(spark):
    rows = spark.createDataFrame([(t,) for t in ITEMS], "t string").select("t", bundles.items(F.col("t")).alias("i"))
    got = {r.t: None if r.i is None else [tuple(x) for x in r.i] for r in rows.collect()}
    assert got == ITEMS


def test_relations(spark):
    cases = {("a + 2 b", "2x B and a"): "AGREE", ("a (x)", "a (x)"): "AGREE", ("a", "a + b"): "DIFFERENT", ("2 a", "a"): "DIFFERENT", ("a (x)", "a"): "UNESTABLISHED", ("a", None): None}
    rows = spark.createDataFrame(list(cases), "a string, b string")
    assert {(r.a, r.b): r.r for r in bundles.relation(rows, "a", "b", "r").collect()} == cases


def test_several_texts(spark):
    texts = {
        1: ["a + b, complete list", "a + b"], 2: ["a + b", "a + b, complete list"], 3: ["a + b", "a + c"], 4: ["a + b", "bundle"], 5: ["bundle", "a + b"], 6: ["a + b, complete list", "bundle (a + b"], 7: ["a"], 8: [],
    }
    want = {1: ("a + b", "ESTABLISHED"), 2: ("a + b", "ESTABLISHED"), 3: ("a + b", "CONTRADICTED_PUBLISHED"), 4: ("a + b", "PARTIAL"), 5: (None, "ABSENT"), 6: ("a + b", "PARTIAL"), 7: ("a", "SYNTACTICALLY_VALID"), 8: None}
    rows = spark.createDataFrame([(k, n, t) for k, v in texts.items() for n, t in enumerate(v)], "k int, n int, t string")
    rows = bundles.composition(rows, "t", "c").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("all"))
    got = {r.k: (r.u.clause, r.u.state) for r in rows.select("k", bundles.united(F.transform("all", lambda x: x["c"])).alias("u")).collect()}
    assert got | {8: None} == want


EST, VALID, PART = ("a + b", "ESTABLISHED", ", full contents"), ("a + b", "SYNTACTICALLY_VALID", None), ("a +", "PARTIAL", None)
OTHER, ODD, TWICE = ("a + c", "ESTABLISHED", ", full contents"), ("a (b)", "ESTABLISHED", ", x"), ("a + b", "CONTRADICTED_PUBLISHED", None)
UNITS = [
    # kind, count, composition, target's, attested side; axis, unit
    ("BUNDLE", 2, EST, "BUNDLE", 2, EST, None, "CONSISTENT", "PROVEN_EQUIVALENT"), ("BUNDLE", None, EST, "BUNDLE", None, EST, None, "BOTH_UNPUBLISHED", "PROVEN_EQUIVALENT"),
    ("BUNDLE", 2, EST, "BUNDLE", 3, EST, None, "CONTRADICTED", "CONTRADICTED"), ("BUNDLE", 2, VALID, "BUNDLE", 3, VALID, None, "CONTRADICTED", "CONTRADICTED"), ("BUNDLE", 2, EST, "BUNDLE", None, EST, None, "UNDETERMINED", "UNPROVEN"),
    ("BUNDLE", 2, EST, "BUNDLE", None, EST, "TARGET", "ATTESTED_NOT_MATERIAL", "PROVEN_EQUIVALENT"), ("BUNDLE", None, EST, "BUNDLE", 2, EST, "CANDIDATE", "ATTESTED_NOT_MATERIAL", "PROVEN_EQUIVALENT"), ("BUNDLE", 2, EST, "BUNDLE", None, EST, "CANDIDATE", "REFUSED", "REFUSED"),
    ("BUNDLE", 2, EST, "BUNDLE", 2, EST, "TARGET", "REFUSED", "REFUSED"), ("BUNDLE", 2, VALID, "BUNDLE", 2, EST, None, "CONSISTENT", "UNPROVEN"), ("BUNDLE", 2, EST, "BUNDLE", 2, VALID, None, "CONSISTENT", "UNPROVEN"), ("BUNDLE", 2, PART, "BUNDLE", 3, EST, None, "CONTRADICTED", "UNPROVEN"),
    ("BUNDLE", 2, None, "BUNDLE", 2, EST, None, "CONSISTENT", "UNPROVEN"), ("BUNDLE", 2, EST, "BUNDLE", 2, None, None, "CONSISTENT", "UNPROVEN"), ("BUNDLE", 2, TWICE, "BUNDLE", 3, EST, None, "CONTRADICTED", "UNPROVEN"), ("BUNDLE", 2, EST, "BUNDLE", 2, OTHER, None, "CONSISTENT", "CONTRADICTED"),
    ("BUNDLE", 2, VALID, "BUNDLE", 2, OTHER, None, "CONSISTENT", "UNPROVEN"), ("BUNDLE", 2, EST, "BUNDLE", 2, ODD, None, "CONSISTENT", "UNPROVEN"), ("BUNDLE", 2, EST, "SINGLE_UNIT", None, None, None, None, "CONTRADICTED"), ("BUNDLE", 2, EST, None, None, None, None, None, "CONTRADICTED"),
    ("PACK_QUANTITY", 5, None, "PACK_QUANTITY", 5, None, None, None, "PROVEN_EQUIVALENT"), ("PACK_QUANTITY", 5, EST, "PACK_QUANTITY", 5, None, None, None, "REFUSED"), ("SINGLE_UNIT", None, None, None, None, None, None, None, "PROVEN_EQUIVALENT"), (None, None, None, None, None, None, None, None, "UNPROVEN"),
]
SCHEMA = f"n int, unit_kind string, unit_quantity int, composition {bundles.CLAUSE}, target_kind string, target_quantity int, target_composition {bundles.CLAUSE}, attested_side string"


def test_units(spark):
    rows = spark.createDataFrame([(n, *u[:7]) for n, u in enumerate(UNITS)], SCHEMA)
    found = bundles.unit_authority(rows).collect()
    got = {r.n: (r.quantity_axis, r.unit_authority) for r in found}
    assert {r.relation for r in found if r.composition and r.target_composition and r.target_composition.clause == "a (b)"} == {"UNESTABLISHED"}
    for n, u in enumerate(UNITS):
        assert got[n] == u[7:], u


@pytest.mark.parametrize("tier", ["AI_ASSISTED_COMPARABLE", "MACHINE_VERIFIED"])
def test_versions(spark, tier):
    rows = spark.createDataFrame([(n, *u[:7]) for n, u in enumerate(UNITS)], SCHEMA)
    rows = bundles.unit_authority(rows).withColumn("tier", F.lit(tier)).crossJoin(spark.createDataFrame([(c,) for c in (*bundles.CONTRACTS, "NEW")], "contract string"))
    got = {(r.n, r.contract[-3:]): r.contract_tier for r in bundles.contract_tier(rows).collect()}
    capped = "NEEDS_REVIEW" if tier == "AI_ASSISTED_COMPARABLE" else tier
    for n, u in enumerate(UNITS):
        composed = u[2] is not None or u[5] is not None or u[6] is not None
        assert got[n, "NEW"] == "REFUSED"
        assert got[n, "FU4"] == ("REFUSED" if u[8] == "REFUSED" else tier if u[8] == "PROVEN_EQUIVALENT" else capped)
        assert (got[n, "FU3"] == "REFUSED") == composed
        assert got[n, "FU2"] == (tier if not composed and u[0] is None and u[3] is None else "REFUSED")
