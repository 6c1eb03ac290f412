"""Price results as payloads: the bytes, the way back, and everything that must not pass."""

import json

import pytest
from pyspark.sql import functions as F

from quoteloom.operators import payloads
from quoteloom.plans.market import assessed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark):
    rows = assessed(spark, SF).where("run_id in ('r1', 'r2', 'r3')")
    found = payloads.encoded(rows).collect()
    return spark.createDataFrame(found), rows


def outcome(spark, written, change, version=1, keep_digest=False):
    row = written[0].orderBy("run_id").first()
    body = change(row.payload)
    changed = spark.createDataFrame([(row.run_id, version, body)], "run_id string, schema_version int, payload string")
    digest = F.lit(row.sha256) if keep_digest else F.sha2("payload", 256)
    return payloads.replayed(changed.withColumn("sha256", digest)).first().outcome


def of(change):
    def run(text):
        body = json.loads(text)
        change(body)
        return json.dumps(body, separators=(",", ":"), ensure_ascii=False)

    return run


def test_rows_come_back(spark, written):
    good, bad = payloads.decoded(written[0])
    columns = [c for c in good.columns if c in written[1].columns]
    assert bad.count() == 0 and len(columns) >= 20
    kinds = {c: t for c, t in good.dtypes}
    before = written[1].select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns))
    assert good.select(*columns).exceptAll(before).count() == 0 and good.count() == written[1].count()


def test_payload_names_assessments(written):
    for row in written[0].collect():
        body = json.loads(row.payload)
        named = [i for b in body["buckets"] for i in b["assessment_indexes"]] + [e["assessment_index"] for e in body["exclusions"]]
        assert sorted(named) == list(range(len(body["assessments"])))
        assert list(body) == sorted(body) and body["verification_status"] == {0: "UNKNOWN", 1: "VERIFIED"}.get(len(body["buckets"]), "AMBIGUOUS")


def test_unchanged_and_whole_changes(spark, written):
    assert {r.outcome for r in payloads.replayed(written[0]).collect()} == {"REPLAYED"}
    assert outcome(spark, written, lambda t: t, version=2) == "UNSUPPORTED_VERSION"
    assert outcome(spark, written, lambda t: t + " ", keep_digest=True) == "DIGEST_MISMATCH"


@pytest.mark.parametrize(
    "change,want",
    [
        (lambda b: b.update(note=1), "NOT_CANONICAL"), (lambda b: b.pop("request"), "NOT_CANONICAL"), (lambda b: b["assessments"][0].pop("rejection_reason"), "NOT_CANONICAL"), (lambda b: b["assessments"][0].update(match_type=5), "NOT_CANONICAL"),
        (lambda b: b["assessments"][0]["normalized_listing"].update(price_amount=1.5), "NOT_CANONICAL"), (lambda b: b["exclusions"][0].update(assessment_index="0"), "NOT_CANONICAL"), (lambda b: b["exclusions"][0].update(assessment_index=True), "NOT_CANONICAL"),
        (lambda b: b["assessments"][0].update(decision="MAYBE"), "UNKNOWN_WORD"), (lambda b: b.update(verification_status=None), "UNKNOWN_WORD"), (lambda b: b["assessments"][0]["normalized_listing"].update(price_amount="NaN"), "BAD_AMOUNT"), (lambda b: b["assessments"][0]["normalized_listing"].update(price_amount="-1.0"), "BAD_AMOUNT"),
        (lambda b: b["exclusions"][0].update(assessment_index=-1), "BAD_INDEX"), (lambda b: b["exclusions"][0].update(assessment_index=10**6), "BAD_INDEX"), (lambda b: b["exclusions"].append(b["exclusions"][0]), "BAD_INDEX"),
        (lambda b: b["exclusions"].pop(), "NOT_DERIVED"), (lambda b: b["exclusions"][0].update(reason="OTHER"), "NOT_DERIVED"), (lambda b: b.update(verification_status="VERIFIED" if len(b["buckets"]) != 1 else "UNKNOWN"), "NOT_DERIVED"), (lambda b: b["exclusions"].reverse(), "NOT_DERIVED"),
    ],
)
def test_changed_payloads(spark, written, change, want):
    assert outcome(spark, written, of(change)) == want


@pytest.mark.parametrize("change", [lambda t: t.replace(":", ": ", 1), lambda t: "x" + t, lambda t: t[:-1], lambda t: t.replace("{", '{"verification_status":"UNKNOWN",', 1), lambda t: t.replace('{"assessments"', '{"Assessments"')])
def test_other_spellings(spark, written, change):
    assert outcome(spark, written, change) == "NOT_CANONICAL"


def test_payloads_are_read_once(spark):
    """A filter that holds the reading of a payload repeats it for each rule; a replay takes one pass."""
    good, bad = payloads.decoded(payloads.encoded(assessed(spark, SF)))
    for found in (good, bad):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not any("from_json" in line for line in plan.splitlines() if "Filter" in line)
    again = payloads.replayed(payloads.encoded(assessed(spark, SF)))
    assert again._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # one listing view: two tables


def test_every_payload_has_an_outcome(spark, written):
    row = written[0].orderBy("run_id").first()
    empty = '{"assessments":[],"buckets":[],"exclusions":[],"request":{"description":null,"requested_mpn":null},"verification_status":"UNKNOWN"}'
    bodies = [row.payload, row.payload, row.payload + " ", empty, empty.replace("UNKNOWN", "VERIFIED")]
    rows = spark.createDataFrame([(row.run_id, 1, b) for b in bodies], "run_id string, schema_version int, payload string").withColumn("sha256", F.sha2("payload", 256))
    assert sorted(r.outcome for r in payloads.replayed(rows).collect()) == ["NOT_CANONICAL", "NOT_DERIVED", "REPLAYED", "REPLAYED", "REPLAYED"]
