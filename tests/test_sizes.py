"""How the work is dealt out: what a small file or a wrong estimate of a size must not decide."""

import pytest

from quoteloom.plans import bundles, evidence, records, support, vendors
from quoteloom.sources.adapters import dealt, view

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_has_as_many_tasks_as_the_cluster(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = dealt(spark.range(100).coalesce(1), "id")
    assert rows.rdd.getNumPartitions() >= cores
    assert rows.count() == 100
    both = view(spark, SF, "SELECT a.p_partkey AS one, b.p_partkey AS two FROM part a JOIN part b ON a.p_partkey = b.p_partkey", part="p_partkey")
    assert both.count() == spark.read.parquet(f"{SF}/part.parquet").count()


@pytest.mark.parametrize("name,plan", [("near_misses", evidence), ("vendor_json_offers", vendors), ("vendor_lookups", vendors), ("bundle_units", bundles), ("bundle_tiers", bundles), ("support_candidates", support), ("packaging_aliases", records)])
def test_rows_of_one_small_file_are_dealt(spark, name, plan):
    assert "REPARTITION_BY_NUM" in plan_of(plan.QUERIES[name](spark, SF))


def test_answers_are_parsed_after_they_are_dealt(spark):
    """A filter on parsed text must not move to the one task that reads the file."""
    lines = plan_of(vendors.vendor_json_offers(spark, SF)).splitlines()
    places = [k for k, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    assert places
    for k in places:  # what stands below an exchange, up to the file
        below = next(j for j in range(k, len(lines)) if "Scan parquet" in lines[j])
        assert not any("json" in line.lower() for line in lines[k + 1 : below])


@pytest.mark.parametrize("name", ["support_specs", "comparable_candidates", "researched_specs", "comparable_similarity"])
def test_records_are_never_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan_of(support.QUERIES[name](spark, SF))


def test_listings_are_dealt_evenly(spark):
    from quoteloom.plans import market

    assert "REPARTITION_BY_NUM" in plan_of(market.quote_rows(spark, SF))
    assert "REPARTITION_BY_COL" not in plan_of(market.quote_rows(spark, SF))


def test_texts_are_split_into_sections_by_one_pattern(spark):
    assert plan_of(vendors.vendor_text_offers(spark, SF)).count("regexp_extract_all(") == 1


def test_text_that_begins_like_no_json_is_not_parsed(spark):
    from pyspark.sql import functions as F

    from quoteloom.functions.text import whole_json

    texts = ["{}", " \n[1]", "-1", '"x"', "true", "null", "<p>x", " Ingram Product: {}", "", "\x0b1", "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", whole_json(F.col("t")).isNotNull().alias("whole"))
    assert [r.t for r in rows.collect() if r.whole] == texts[:6]
    assert "parseJson(concat([, CASE WHEN" in plan_of(rows)  # null but for texts that may be JSON


def test_sections_of_many_short_lines(spark):
    """Every kind of line break, and more lines than a pattern may nest."""
    from quoteloom.sources import vendors as source

    bodies = ["x\r\nCDW Product: a\r\n\r\nb  <p>Ingram Product: c\x85d\n", "CDW Product: x" + "\r\n" * 300000 + "Ingram Product: y"]
    rows = source.sections(spark.createDataFrame(list(enumerate(bodies)), "run_id long, body string"))
    got = {(r.run_id, r.source_name): r.text for r in rows.collect()}
    assert got == {(0, "CDW"): " a\n\nb\n", (0, "Ingram"): " c\nd\n", (1, "CDW"): " x" + "\n" * 300000, (1, "Ingram"): " y"}


def test_an_entry_of_a_clause_is_read_once(spark):
    """Functions of arrays share nothing between their uses, so what is used often must be a step of its own."""
    from pyspark.sql import functions as F

    from quoteloom.operators import bundles as operator

    rows = spark.createDataFrame([("2x Drive + 007 bag + cable",), ("12 Cable &  a  b, 1x",), (" 3\tBig   box ",), ("99999999999x a",), (None,)], "t string").select(operator.items(F.col("t")).alias("i"), operator._is_open(F.col("t")).alias("o"))
    got = [r.i and [tuple(e) for e in r.i] for r in rows.collect()]
    assert got == [None, None, [(3, "big box")], None, None]
    plan = plan_of(rows)
    assert plan.count("regexp_extract(") == 1 and plan.count("forall(") == 1 and plan.count("array_join(") == 1


def test_keys_of_aliases_are_made_once(spark):
    from pyspark.sql import functions as F

    from quoteloom.operators import aliases as operator

    rows = spark.createDataFrame([("m1 ", "M1", "m1r"), ("M1T", "M1", " m1"), ("M1X", "M1", "M1"), (None, "M1", "M1"), ("M1", None, "M1"), ("M1", "M1", None), ("", "", "")], "q string, b string, p string")
    names = rows.withColumn("n", operator.aliases(F.col("q"), F.col("b")))
    got = [(r.n, r.r) for r in names.withColumn("r", operator.reference(F.col("n"), F.col("p"))).collect()]
    assert got == [(["M1R", "M1T"], "M1R"), (["M1", "M1R"], "M1"), (None, None), (None, None), (None, None), (["M1R", "M1T"], None), (None, None)]
    assert plan_of(names).count("translate(") <= 12  # two for each of the keys of request, form, and (twice) both bases


def test_each_spelling_of_a_specification_is_read_once(spark):
    from quoteloom.functions.specs import normalize, spelled_once

    values = [("capacity", "3.84 TB"), ("capacity", "3,840 GB"), ("capacity", None), (None, "1 TB"), (None, None), ("endurance_dwpd", ""), ("sequential_read", "3.84 TB"), ("storage_protocol", "NVMe"), ("other", "x"), ("capacity", "3.84 tb")]
    rows = spark.createDataFrame([(k % 3, key, raw) for k in range(4) for key, raw in values], "product_id int, definition_key string, raw_value string")
    one, two = (f(rows).select("product_id", "definition_key", "raw_value", "value_kind", "value_text", "value_dec", "issue") for f in (normalize, spelled_once))
    assert one.count() == two.count() == 40 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert "HashAggregate(keys=[_key" in plan_of(records.united_specs(spark, SF))


def parts_of_groups():
    """Groups of many, few and one, numbers of a part in two groups, twice in one, and nulls."""
    rows = [(k, "B1" if k % 3 else "B2", 1 + k % 2) for k in range(1, 60)] + [(100 * k, "B3", 7) for k in range(1, 13)]
    return rows + [(5, "B3", 7), (5, "B3", 7), (500, "B1", 2), (12345, "B9", 1), (123456, "B9", 1), (9, None, 1), (8, None, 1), (7, "B3", None), (None, "B3", 7), (None, "B3", 7)]


def test_every_pair_of_a_group_is_met_once_by_blocks(spark, monkeypatch, tmp_path):
    """Whatever the size of a block, the rows are those of the SQL, and no key holds more than a block of a side."""
    import duckdb

    from quoteloom.operators import pairs as operator

    rows = spark.createDataFrame(parts_of_groups(), "p_partkey bigint, p_brand string, p_size int")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(connection.execute(f"SELECT part, two, shape FROM ({evidence.ORACLES['near_misses']})").fetchall(), key=repr)
    assert {shape for _, _, shape in want} == {None, "TRUNCATION", "SUBSTITUTION"}
    for block in (1, 4, 1000):
        monkeypatch.setattr(operator, "BLOCK", block)
        got = evidence.near_misses(spark, str(tmp_path))
        assert sorted(map(tuple, got.select("part", "two", "shape").collect()), key=repr) == want
    monkeypatch.setattr(operator, "BLOCK", 4)
    cut = operator.blocks(rows, ["p_brand", "p_size"], ["p_partkey"]).groupBy("p_brand", "p_size", "_own", "_other").count().collect()
    assert max(r["count"] for r in cut) == 4 and min(r["count"] for r in cut) >= 1
    assert len({(r["_own"], r["_other"]) for r in cut if r["p_brand"] == "B3"}) == 16  # sixteen rows, four blocks


def test_pairs_are_compared_in_generated_code_and_joined_in_blocks(spark):
    plan = plan_of(evidence.near_misses(spark, SF))
    assert "zip_with" not in plan and "aggregate(" not in plan  # functions of arrays are interpreted, for each pair
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "row_number()" in plan


def test_near_miss_by_outlines_is_that_by_characters(spark):
    from pyspark.sql import functions as F

    from quoteloom.functions import part_number as pn

    texts = ["", "A", "B", "AB", "AC", "CB", "ABC", "BCA", "CAB", "ABCD", "ABXD", "AXXD", "\U0001f600B", "\U0001f601B", "\U0001f600C", "äB", "ä", "A" * 70, "A" * 69 + "B", "B" + "A" * 69, None]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "one string, two string")
    one, two = F.col("one"), F.col("two")
    got = rows.select("one", "two", pn.near_miss(one, two).alias("plain"), pn.near_miss(one, two, pn.outline(one), pn.outline(two)).alias("shape")).collect()

    def shape(a, b):
        if not a or not b or a == b:
            return None
        if a.startswith(b) or b.startswith(a):
            return "TRUNCATION"
        return "SUBSTITUTION" if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 else None

    want = {(a, b): shape(a, b) for a in texts for b in texts}
    assert {(r.one, r.two): r.shape for r in got} == {(r.one, r.two): r.plain for r in got} == want
