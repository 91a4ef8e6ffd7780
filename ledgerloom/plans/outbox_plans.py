"""Queries on delivery: events are queued items of ten queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import outbox
from ledgerloom.plans.files import write_files
from ledgerloom.plans.registry import query, table
from ledgerloom.session import shared_dir
from ledgerloom.sources.records import read_json, read_queue, read_states, with_state

STATUSES = (0, 200, 404, 408, 429, 500, 400, 401, 422)
NOW = "2024-02-01 00:00:00"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    nxt = F.when(k % 6 == 0, "never").when(k % 6 == 1, "2030-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00Z")
    return e.select(
        (F.col("user_id") % 10).alias("queue"), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), F.lpad(k.cast("string"), 9, "0"), F.lit(".json")).alias("name"), (k % 10).cast("int").alias("attempts"),
        nxt.alias("next_attempt_at"), (k % 7 != 0).alias("readable"), F.element_at(F.array(*map(F.lit, STATUSES)), (k % 9 + 1).cast("int")).alias("status"),
        F.when(k % 4 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("last_error"), k.alias("event_id"),
    )


ITEMS = f"""i AS (SELECT event_id, user_id % 10 AS queue, strftime(ts, '%Y-%m-%d') || '-' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.json' AS name, CAST(event_id % 10 AS INTEGER) AS attempts, event_id % 6 <> 1 AS due,
event_id % 7 <> 0 AS readable, {list(STATUSES)}[CAST(event_id % 9 + 1 AS INTEGER)] AS status, CASE WHEN event_id % 4 = 0 THEN 'e' || event_id END AS last_error FROM events),
o AS (SELECT *, CASE WHEN NOT readable THEN 'quarantined' WHEN status = 200 THEN 'delivered' WHEN (status IN (0, 404, 408, 429) OR status >= 500) AND attempts + 1 < 8 THEN 'retrying' ELSE 'quarantined' END AS tried FROM i),
d AS (SELECT *, CASE WHEN coalesce(sum(CAST(due AND readable AS INTEGER)) OVER (PARTITION BY queue ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 25 THEN 'waiting' WHEN NOT due THEN 'deferred' ELSE tried END AS outcome FROM o)"""


def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.drain(items(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(f"WITH {ITEMS} SELECT event_id, tried AS outcome FROM o")
def outbox_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("event_id", outbox.outcome(F.col("readable"), F.col("status"), F.col("attempts")).alias("outcome"))


@query(f"""WITH {ITEMS}, n AS (SELECT *, attempts + CASE WHEN readable AND outcome IN ('retrying', 'quarantined') THEN 1 ELSE 0 END AS next_attempts FROM d)
SELECT event_id, outcome, next_attempts, CASE WHEN outcome = 'retrying' THEN CAST(least(21600, 30 * pow(2, greatest(0, next_attempts - 1))) AS BIGINT) END AS wait_seconds FROM n""")
def outbox_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run over every queue: outcome, attempts, backoff."""
    return drained(spark, sf_dir).select("event_id", "outcome", "next_attempts", "wait_seconds")


@query(f"""WITH {ITEMS} SELECT event_id, outcome, CASE WHEN outcome = 'retrying' THEN TIMESTAMP '{NOW}' + to_seconds(CAST(least(21600, 30 * pow(2, attempts)) AS BIGINT)) END AS next_attempt_at,
CASE WHEN outcome IN ('retrying', 'quarantined') AND readable THEN status END AS last_status, CASE WHEN outcome IN ('retrying', 'quarantined') THEN CASE WHEN readable THEN substr('refused with ' || status || repeat('x', event_id % 400), 1, 300) ELSE 'unreadable item' END END AS last_error FROM d""")
def outbox_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next state of every item after one run: when it is due again, and the last answer, its text cut."""
    error = F.when(F.col("readable"), F.concat(F.lit("refused with "), F.col("status").cast("string"), F.repeat(F.lit("x"), (F.col("event_id") % 400).cast("int"))))
    done = outbox.drain(items(spark, sf_dir).withColumn("error", error), F.lit(NOW).cast("timestamp"))
    return done.select("event_id", "outcome", F.col("next_due").cast("timestamp_ntz").alias("next_attempt_at"), "last_status", "last_error")


@query(f"WITH {ITEMS} SELECT queue, count(*) FILTER (outcome = 'delivered') AS delivered, count(*) FILTER (outcome = 'retrying') AS retrying, count(*) FILTER (outcome = 'quarantined') AS quarantined, count(*) FILTER (outcome = 'deferred') AS deferred FROM d GROUP BY queue")
def outbox_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.report(drained(spark, sf_dir), "queue")


@query(f"WITH {ITEMS} SELECT count(*) FILTER (readable) AS pending, count(*) FILTER (readable AND due) AS due, substr(min(name) FILTER (readable), 1, 10) AS oldest, max_by(last_error, name) FILTER (readable AND last_error IS NOT NULL) AS last_error, count(*) FILTER (NOT readable) AS quarantined, CASE WHEN count(*) FILTER (NOT readable) > 0 THEN 'quarantined' ELSE 'backlog' END AS health FROM i")
def outbox_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return outbox.health(outbox.status(i.filter("readable"), i.filter("not readable"), F.lit(NOW).cast("timestamp")))


@query(f"WITH {ITEMS} SELECT name, CASE WHEN event_id % 3 = 0 THEN attempts ELSE 0 END AS attempts, CASE WHEN event_id % 3 = 0 THEN 'later' ELSE '1970-01-01T00:00:00.000Z' END AS next_attempt_at FROM i")
def outbox_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items joined with their states, where they have one."""
    i = items(spark, sf_dir)
    state = i.filter("event_id % 3 = 0").select("name", "attempts", F.lit("later").alias("next_attempt_at"))
    return with_state(i.select("name"), state).select("name", "attempts", "next_attempt_at")


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.json' AS name, CAST(CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 5 ELSE 0 END AS INTEGER) AS attempts,
CASE WHEN c_custkey % 6 = 0 THEN 'later' ELSE '1970-01-01T00:00:00.000Z' END AS next_attempt_at, md5(c_name) AS digest FROM customer WHERE c_custkey % 10 < 4""")
def queue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files of a queue, some beside their state, every 9th of these broken, and a configuration that is no item."""
    k, folder = F.col("c_custkey"), f"{shared_dir(spark)}/queue"
    c = table(spark, sf_dir, "customer").filter(k % 10 < 4)
    name = F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit(".json"))
    state = F.when(k % 6 == 0, F.to_json(F.struct((k % 5).alias("attempts"), F.lit("later").alias("next_attempt_at")))).otherwise("{broken")
    write_files(c.select(name.alias("name"), F.to_json(F.struct("c_name")).alias("content")), folder)
    write_files(c.filter((k % 6 == 0) | (k % 9 == 0)).select(F.concat(name, F.lit(".state.json")).alias("name"), state.alias("content")), folder)
    write_files(c.limit(1).select(F.lit("config.json").alias("name"), F.lit("{}").alias("content")), folder)
    listed = with_state(read_queue(spark, folder), read_states(spark, folder))
    return listed.select("name", "attempts", "next_attempt_at", F.md5(F.get_json_object("content", "$.c_name")).alias("digest"))


@query("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS nation FROM supplier")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as JSON files, an object or a list a file, read again."""
    k, folder = F.col("s_suppkey"), f"{shared_dir(spark)}/json"
    one = F.struct(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, F.col("s_nationkey")).alias("nation"))
    s = table(spark, sf_dir, "supplier")
    write_files(s.filter(k % 3 > 0).select(F.concat(k.cast("string"), F.lit(".json")).alias("name"), F.to_json(one, {"pretty": "true"}).alias("content")), folder)
    lists = s.filter(k % 3 == 0).groupBy((k % 4).alias("g")).agg(F.to_json(F.collect_list(one)).alias("content"))
    write_files(lists.select(F.concat(F.lit("list"), F.col("g").cast("string"), F.lit(".json")).alias("name"), "content"), folder)
    return read_json(spark, folder, "id bigint, name string, nation bigint")


@query("SELECT user_id, CASE WHEN bool_or(event_id % 50 = 0) THEN 'needs_login' WHEN bool_or(event_id % 5 = 0) THEN 'degraded' ELSE 'ok' END AS health FROM events GROUP BY user_id")
def doctor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    checks = table(spark, sf_dir, "events").select("user_id", F.when(k % 50 == 0, "needs_login").when(k % 5 == 0, "failed").otherwise("ok").alias("state"))
    return outbox.rollup(checks, "user_id")
