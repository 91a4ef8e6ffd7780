from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import outbox, search, usage
from ledgerloom.streaming import delivery, windows


def test_step_equals_batch_transition(spark):
    cases = [(a, s) for a in range(9) for s in (0, 200, 204, 404, 408, 429, 500, 503, 400, 401, 403, 422)]
    rows = spark.createDataFrame(cases, "attempts int, status int")
    for r in rows.withColumn("o", outbox.outcome(F.lit(True), F.col("status"), F.col("attempts"))).collect():
        assert delivery.step(r.attempts, r.status)[1] == r.o


def test_windows_on_a_table(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=m), 1, "a", 1.0) for i, m in enumerate((0, 10, 50, 130, 140))]
    e = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    assert sorted(r.n for r in windows.tumbling(e).collect()) == [2, 3]
    assert sorted(r.n for r in windows.sessions(e).collect()) == [1, 2, 2]
    assert sum(r.n for r in windows.sliding(e, "1 hour", "30 minutes").collect()) == 10


def test_drain_limit_and_bad_times(spark):
    rows = [("q", f"{i:02}", 0, "bad" if i % 2 else "2030-01-01", True, 200, None) for i in range(8)] + [("q", "99", 0, "bad", False, 200, None)]
    items = spark.createDataFrame(rows, "queue string, name string, attempts int, next_attempt_at string, readable boolean, status int, last_error string")
    got = {r.name: r.outcome for r in outbox.drain(items, F.lit("2024-01-01").cast("timestamp"), limit=3).collect()}
    assert [got[f"{i:02}"] for i in range(8)] == ["deferred", "delivered"] * 3 + ["waiting", "waiting"] and got["99"] == "waiting"
    late = {r.name: r.outcome for r in outbox.drain(items, F.lit("2024-01-01").cast("timestamp"), limit=9).collect()}
    assert late["99"] == "quarantined" and late["06"] == "deferred"


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([("s", 1, 5), ("t", 1, 1)], "k string, at int, total int")
    new = spark.createDataFrame([("s", 2, 3), ("u", 1, 9)], "k string, at int, total int")
    assert {tuple(r) for r in usage.upsert(old, new, "k", "at").collect()} == {("s", 2, 3), ("t", 1, 1), ("u", 1, 9)}


def test_filters():
    assert search.build_filter({"source": "x", "lang": "a"}, ["lang:b:c", "bad", ":x", "y:"], ["s"]) == {"source": "s", "lang": "b:c"}
    assert search.build_filter() == {}
