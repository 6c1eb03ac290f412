"""The log of steps: which rows may be, and batches that come once, twice, broken or at the same time."""

from collections import Counter

import pytest

from quoteloom.sinks import evidence


def entries(spark, *rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], evidence.COLUMNS)


GOOD = [("SEARCH", "SUCCESS", "OK", ""), ("FETCH", "SKIPPED", None, "https://a.example/x"), ("MATCH", "SUCCESS", None, None), ("SEMANTIC", "FAILED", "SEMANTIC_UNAVAILABLE", "http://b.example")]
BAD = [
    (("SEARCH", "BLOCKED", "OK", ""), "UNKNOWN_STEP"), (("LOOK", "SUCCESS", "OK", ""), "UNKNOWN_STEP"), ((None, "SUCCESS", "OK", ""), "UNKNOWN_STEP"), (("SEARCH", "SUCCESS", None, ""), "BAD_DETAIL"), (("FETCH", "SUCCESS", "TIMEOUT", ""), "BAD_DETAIL"),
    (("FETCH", "SKIPPED", "OK", ""), "BAD_DETAIL"), (("FETCH", "SUCCESS", "OK", "ftp://a.example"), "BAD_URL"), (("FETCH", "SUCCESS", "OK", "https://"), "BAD_URL"), (("FETCH", "SUCCESS", "OK", "x"), "BAD_URL"),
]


def test_rows(spark):
    got = evidence.checked(entries(spark, *GOOD, *(r for r, _ in BAD))).orderBy("seq").collect()
    assert [r.problem for r in got] == [None] * len(GOOD) + [p for _, p in BAD]
    secret = evidence.checked(entries(spark, ("FETCH", "SUCCESS", "OK", "https://user:word@a.example/x"))).first()
    assert (secret.problem, secret.candidate_url) == (None, "")


def test_batches(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    assert evidence.read(spark, folder).count() == 0
    assert evidence.publish(entries(spark, *GOOD), folder, 7) == "PUBLISHED"
    assert evidence.publish(entries(spark, *GOOD[:1]), folder, 7) == "REPEATED"
    for row, _ in BAD[:2]:
        assert evidence.publish(entries(spark, *GOOD, row), folder, 3) == "REFUSED"
    assert evidence.publish(entries(spark, *GOOD[1:3]), folder, 3) == "PUBLISHED"
    assert evidence.publish(entries(spark), folder, 9) == "PUBLISHED"
    got = evidence.read(spark, folder).orderBy("attempt_number").collect()
    assert [(r.batch, r.stage, r.attempt_number, r.problem) for r in got] == [(3, "FETCH", 1, None), (3, "MATCH", 2, None), *((7, g[0], k + 3, None) for k, g in enumerate(GOOD))]
    assert len(list((tmp_path / "log").glob("data-*"))) == 3  # nothing of refused and repeated ones


def test_a_half_written_batch_is_not_seen(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/log"
    monkeypatch.setattr(evidence, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        evidence.publish(entries(spark, *GOOD), folder, 1)
    monkeypatch.undo()
    assert evidence.read(spark, folder).count() == 0
    assert evidence.publish(entries(spark, *GOOD), folder, 1) == "PUBLISHED"
    assert evidence.read(spark, folder).count() == len(GOOD)


def test_one_of_two_writers_wins(spark, tmp_path):
    assert [evidence._commit(spark, str(tmp_path), 5, name) for name in ("one", "two")] == [True, False]
    assert evidence.committed(spark, str(tmp_path)) == {5: "one"}


def test_a_stream_that_runs_twice_publishes_once(spark, tmp_path):
    for k in range(3):
        entries(spark, *GOOD).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    said = []
    for run in range(2):  # the second has lost its progress and reads all again
        stream = spark.readStream.schema(evidence.COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/progress{run}").foreachBatch(lambda rows, batch: said.append(evidence.publish(rows, f"{tmp_path}/log", batch))).trigger(availableNow=True).start()
        query.awaitTermination()
    assert Counter(said) == {"PUBLISHED": 3, "REPEATED": 3}
    assert evidence.read(spark, f"{tmp_path}/log").count() == 3 * len(GOOD)
