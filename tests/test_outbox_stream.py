"""Timers, limits and states of the outbox, as a batch and as a stream."""

import time

import pytest
from ledgerloom.operators import outbox as batch
from ledgerloom.streaming import outbox
from pyspark.sql import functions as F

SCHEMA = "queue int, name string, content string, arrived timestamp"


def receiver():
    def deliver(name, content, attempts):  # goes to the workers by value
        if "down" in content and attempts < 1:
            raise ConnectionError("no network " + "y" * 500)
        return (200, None) if "never" not in content else (422, "bad")

    return deliver


def start(spark, folder, out, **how):
    outbox.use_timers(spark)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    if how.get("event_time"):
        stream = stream.withWatermark("arrived", "0 seconds")
    return outbox.outbox(stream, receiver(), **how).writeStream.foreachBatch(lambda rows, n: out.extend(rows.collect())).option("checkpointLocation", f"{folder}/state").outputMode("update")


def put(spark, folder, rows):
    frame = spark.createDataFrame(rows, "queue int, name string, content string, arrived string")
    frame.withColumn("arrived", F.col("arrived").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_retry_without_new_input(spark, tmp_path):
    """By the wall clock: a backoff ends and its item is sent again though nothing arrives; what ended isn't sent twice."""
    rows = [(1, "a", '{"x": "down"}', "2024-01-01"), (1, "b", "{broken", "2024-01-01"), (1, "c", "{}", "2024-01-01"), (2, "d", '"never"', "2024-01-01")]
    put(spark, tmp_path, rows)
    out = []
    running = start(spark, tmp_path, out, pause=1, base=2).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and sum(r.outcome != "retrying" for r in out) < 4 and running.isActive:
            time.sleep(0.5)
        put(spark, tmp_path, [rows[2], (3, "e", "{}", "2024-01-01")])  # the first of them once more
        while time.time() < until + 30 and not any(r.name == "e" for r in out) and running.isActive:
            time.sleep(0.5)
    finally:
        running.stop()
    seen = sorted((r.name, r.outcome, r.attempts, r.last_status) for r in out)
    assert seen == [("a", "delivered", 1, 200), ("a", "retrying", 1, 0), ("b", "quarantined", 0, None), ("c", "delivered", 0, 200), ("d", "quarantined", 1, 422), ("e", "delivered", 0, 200)]
    by = {(r.name, r.outcome): r for r in out}
    assert len(by["a", "retrying"].last_error) == 300 and by["b", "quarantined"].content == "{broken" and by["d", "quarantined"].last_error == "bad"
    assert by["a", "delivered"].at >= by["a", "retrying"].next_attempt_at > by["a", "retrying"].at


def test_event_time_is_the_same_for_any_batches(spark, tmp_path):
    """One file or one a day: the same runs at the same times, two sends a run."""
    days = [[(q, f"{d}{i}", ('"down"', "{}", '"never"')[(i + d) % 3], f"2024-01-0{d + 1}") for q in (1, None) for i in range(5)] for d in range(4)]
    found = []
    for name, cuts in (("one", [sum(days, [])]), ("many", days)):
        for rows in cuts:
            put(spark, tmp_path / name, rows)
            out = []
            start(spark, tmp_path / name, out, limit=2, pause=60, event_time=True).trigger(availableNow=True).start().awaitTermination()
            found.append((name, [(r.queue, r.name, r.outcome, r.attempts, r.at, r.next_attempt_at) for r in out]))
    one, many = (sorted(sum((rows for n, rows in found if n == name), []), key=str) for name in ("one", "many"))
    assert one == many and len(one) > 30
    runs = {}
    for queue, _, _, _, at, _ in one:
        runs[queue, at] = runs.get((queue, at), 0) + 1
    assert max(runs.values()) == 2


def test_lanes_share_a_queue(spark, tmp_path):
    put(spark, tmp_path, [(1, f"n{i}", "{}", "2024-01-01") for i in range(40)] + [(2, "later", "{}", "2024-01-02")])
    out = []
    start(spark, tmp_path, out, lanes=4, limit=25, event_time=True).trigger(availableNow=True).start().awaitTermination()
    assert {r.outcome for r in out} == {"delivered"} and len(out) == 41 and len({r.lane for r in out}) == 4


@pytest.mark.parametrize("limit", [0, 1, 3, 50])
def test_limit_of_a_run(spark, limit):
    """The batch run touches what comes before the limit is used up, in a queue without a name too."""
    rows = [(q, f"{i:02}", i % 9, None if i % 4 else "2999-01-01", i % 5 != 0, (200, 500, 422)[i % 3]) for q in (1, 2, None) for i in range(20)] + [(9, "x", 0, None, False, 0)]
    items = spark.createDataFrame(rows, "queue int, name string, attempts int, next_attempt_at string, readable boolean, status int")
    got = {(r.queue, r.name): r for r in batch.drain(items, F.lit("2024-01-01").cast("timestamp"), limit).collect()}
    for q in (1, 2, None, 9):
        sent = 0
        for queue, name, attempts, at, readable, status in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            due = at is None
            want = "waiting" if sent >= limit else "deferred" if not due else "quarantined" if not readable else "delivered" if status == 200 else "retrying" if status == 500 and attempts < 7 else "quarantined"
            sent += want not in ("waiting", "deferred") and readable
            r = got[queue, name]
            assert r.outcome == want and r.next_attempts == attempts + (readable and want in ("retrying", "quarantined"))
            assert (r.next_due is not None) == (want == "retrying") and (r.last_status is not None) == (readable and want in ("retrying", "quarantined"))
    assert len(got) == len(rows)


class Store:
    """State in memory that counts the calls to it."""

    def __init__(self):
        self.calls, self.timers, self.made = 0, [], {}

    def registerTimer(self, ms):
        self.timers.append(ms)

    def _state(self, name, *schema):
        store = self

        class State:
            held = store.made.setdefault(name, {})

            def __getattribute__(own, call):
                store.calls += call not in ("held", "__class__")
                return object.__getattribute__(own, call)

            iterator = lambda own: iter(list(own.held.items()))
            containsKey = lambda own, k: k in own.held
            getValue = lambda own, k: own.held.get(k)
            updateValue = lambda own, k, v: own.held.update({k: v})
            removeKey = lambda own, k: own.held.pop(k, None)
            exists = lambda own: bool(own.held)
            update = lambda own, v: own.held.update({0: v})
            clear = lambda own: own.held.clear()
            get = lambda own: iter(list(own.held.values())) if name == "ended" else own.held.get(0)
            appendList = lambda own, rows: own.held.update({len(own.held) + i: r for i, r in enumerate(rows)})

            def put(own, rows):
                own.held.clear()
                own.held.update(enumerate(rows))

        return State()

    getMapState = getListState = getValueState = _state


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getCurrentProcessingTimeInMs = lambda: ms


@pytest.mark.parametrize("event_time", [True, False])
def test_calls_to_the_store(event_time):
    """A queue's items move in blocks: 3,000 items, each sent twice and all ended after two tries, take under 200 calls; long, null and broken contents too."""
    import pandas as pd

    tried, store = [], Store()
    receive = lambda name, content, attempts: tried.append((name, len(content), attempts)) or (500 if attempts == 0 else 200, None)
    box = outbox.Outbox(receive, 10_000, 8, 1, 100_000, 2, 100, event_time)
    box.init(store)
    contents = {f"{i:05}": None if i == 7 else "{broken" if i == 8 else '"' + "é" * (2000 if i % 1000 == 0 else 5) + '"' for i in range(3000)}
    rows = pd.DataFrame({"name": [*contents, *contents], "content": [*contents.values()] * 2, "ms": 1000})
    got = list(box.handleInputRows(("q", 0), iter([rows]), Clock(0 if event_time else 2000)))
    for clock in (2000, 3_000, 10_000, 20_000):
        got += box.handleExpiredTimer(("q", 0), Clock(clock), None)
    got += box.handleInputRows(("q", 0), iter([rows]), Clock(20_001))  # known still
    got = pd.concat(g for g in got if len(g))
    assert len(got) == 2 + 2 * 2998 and got.outcome.value_counts().to_dict() == {"retrying": 2998, "delivered": 2998, "quarantined": 2}
    assert sorted(tried) == sorted((n, len(c), k) for n, c in contents.items() if c not in (None, "{broken") for k in (0, 1))
    assert got[got.outcome == "quarantined"].content.tolist() == [None, "{broken"]
    assert not store.made["blocks"] and not store.made["contents"] and store.calls < 200, store.calls
