"""Streaming queries, run to the end of their input and compared with the same SQL as a batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.files import write_files
from ledgerloom.plans.registry import query, table
from ledgerloom.session import shared_dir
from ledgerloom.streaming import delivery, outbox, queue_files, windows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{'events.parquet' if os.path.isdir(f'{sf_dir}/events.parquet') else 'events.parque[t]'}")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there; its rows as a table in the shared folder."""
    spark, root = stream.sparkSession, shared_dir(stream.sparkSession)
    if mode == "append":
        done = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch_", F.lit(batch)).write.mode("append").parquet(f"{root}/out")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4))) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts, complete at the end of input."""
    out = finished(windows.tumbling(events(spark, sf_dir)), "complete")
    return _last(out, "start", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH p AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS start FROM events, range(4) AS r(k)) SELECT CAST(start AS TIMESTAMP) AS start, count(*) AS n FROM p GROUP BY ALL""")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each hour that begins on a quarter, of a table."""
    out = windows.sliding(table(spark, sf_dir, "events"), "1 hour", "15 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH s AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, ts, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions, which end 30 minutes after their last event, of a table."""
    out = windows.sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice in, once out."""
    twice = events(spark, sf_dir).select("event_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return finished(windows.unique_events(twice).select("event_id"), "append")


@query("SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY user_id")
def stream_session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session totals that each batch replaces."""
    out = finished(events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")), "update")
    return _last(out, "user_id").select("user_id", "n", "ids")


STEPS = """t AS (SELECT user_id, event_id, [0, 200, 404, 408, 429, 500, 400, 401, 422][CAST((event_id * 5 + user_id) % 9 + 1 AS INTEGER)] AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
e AS (SELECT user_id, min(k) FILTER (status IN (200, 400, 401, 422) OR k = 8) AS stop, max(k) AS top FROM t GROUP BY user_id)"""


@query(f"""WITH {STEPS} SELECT 'item-' || user_id AS name, CAST(CASE WHEN stop IS NULL THEN top WHEN status = 200 THEN stop - 1 ELSE stop END AS INTEGER) AS attempts, CASE WHEN stop IS NULL THEN 'retrying' WHEN status = 200 THEN 'delivered' ELSE 'quarantined' END AS outcome FROM e LEFT JOIN t ON t.user_id = e.user_id AND k = stop""".replace("SELECT 'item-' || user_id", "SELECT 'item-' || e.user_id"))
def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as keyed state machines over a stream of tries."""
    k, u = F.col("event_id"), F.col("user_id")
    status = F.element_at(F.array(*map(F.lit, (0, 200, 404, 408, 429, 500, 400, 401, 422))), ((k * 5 + u) % 9 + 1).cast("int"))
    tries = events(spark, sf_dir).select(F.concat(F.lit("item-"), u.cast("string")).alias("name"), k.alias("ord"), status.alias("status"))
    return _last(finished(delivery.deliveries(tries), "update"), "name").select("name", "attempts", "outcome")


OUTBOX_LIMIT, OUTBOX_PAUSE = 2, 600
#: Runs of all queues: each step is the next run of every queue that has one before the last day begins.
OUTBOX_RUNS = f"""WITH RECURSIVE i AS (SELECT user_id AS queue, lpad(CAST(event_id AS VARCHAR), 9, '0') || '.json' AS name, event_id AS k, event_id % 7 <> 0 AS readable, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS arrived FROM events),
clock AS (SELECT max(arrived) AS w FROM i),
r AS (SELECT queue, name, k, readable, 0 AS attempts, arrived AS next, CAST(NULL AS BIGINT) AS last, 'waiting' AS outcome, CAST(NULL AS INTEGER) AS status, CAST(NULL AS BIGINT) AS at_s FROM i
  UNION ALL SELECT queue, name, k, readable, CASE WHEN sent AND tried <> 200 THEN attempts + 1 ELSE attempts END, CASE WHEN result = 'retrying' THEN run + CAST(least(21600, 30 * pow(2, attempts)) AS BIGINT) WHEN touched THEN NULL ELSE next END,
    run, CASE WHEN touched THEN result ELSE 'waiting' END, CASE WHEN sent THEN tried ELSE status END, CASE WHEN touched THEN run END
  FROM (SELECT *, CASE WHEN NOT touched THEN NULL WHEN NOT readable THEN 'quarantined' WHEN tried = 200 THEN 'delivered' WHEN (tried IN (0, 404, 408, 429) OR tried >= 500) AND attempts + 1 < 8 THEN 'retrying' ELSE 'quarantined' END AS result, touched AND readable AS sent
    FROM (SELECT *, next <= run AND coalesce(sum(CAST(readable AND next <= run AS INTEGER)) OVER (PARTITION BY queue ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {OUTBOX_LIMIT} AS touched
      FROM (SELECT *, [0, 200, 404, 408, 429, 500, 400, 401, 422][CAST((k + 4 * attempts) % 9 + 1 AS INTEGER)] AS tried, greatest(min(next) OVER (PARTITION BY queue), coalesce(last + {OUTBOX_PAUSE}, 0)) AS run FROM r WHERE next IS NOT NULL) WHERE run <= (SELECT w FROM clock))))"""


def _answer(name: str, content: str, attempts: int) -> tuple[int, str | None]:
    """A receiver that answers by an item's number and the tries it has had."""
    status = (0, 200, 404, 408, 429, 500, 400, 401, 422)[(int(name[:9]) + 4 * attempts) % 9]
    if status == 0:
        raise ConnectionError("no network")
    return status, f"refused with {status}: " + "x" * 400


@query(f"""{OUTBOX_RUNS}, t AS (SELECT * FROM r WHERE at_s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY at_s DESC) = 1)
SELECT CAST(queue AS VARCHAR) AS queue, name, outcome, CAST(attempts AS INTEGER) AS attempts, to_timestamp(next) AT TIME ZONE 'UTC' AS next_attempt_at, status AS last_status,
CASE WHEN NOT readable THEN 'unreadable item' WHEN status = 0 THEN 'no network' WHEN status <> 200 THEN substr('refused with ' || status || ': ' || repeat('x', 400), 1, 300) END AS last_error, to_timestamp(at_s) AT TIME ZONE 'UTC' AS run_at FROM t""")
def stream_outbox_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of their users' queues, each sent twice into the stream: two sends a run, runs ten minutes apart, retries when their backoff ends."""
    k = F.col("event_id")
    content = F.when(k % 7 == 0, "{broken").otherwise(F.to_json(F.struct("event_id")))
    items = events(spark, sf_dir).select(
        F.col("user_id").alias("queue"), F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit(".json")).alias("name"), content.alias("content"),
        F.date_trunc("day", "ts").alias("arrived"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"),
    )
    outbox.use_timers(spark)
    out = finished(outbox.outbox(items.withWatermark("arrived", "0 seconds"), _answer, OUTBOX_LIMIT, pause=OUTBOX_PAUSE, keep=3600, event_time=True), "update")
    last = out.groupBy("queue", "name").agg(F.max_by(F.struct("outcome", "attempts", "next_attempt_at", "last_status", "last_error", "at"), "at").alias("r"))
    stamp = lambda c: F.col(f"r.{c}").cast("timestamp_ntz")
    return last.select("queue", "name", "r.outcome", "r.attempts", stamp("next_attempt_at").alias("next_attempt_at"), "r.last_status", "r.last_error", stamp("at").alias("run_at"))


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.json' AS name, CAST(CASE WHEN c_custkey % 3 > 0 OR c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
CASE WHEN c_custkey % 3 > 0 OR c_custkey % 7 = 0 THEN '1970-01-01T00:00:00.000Z' ELSE 'later' || c_custkey END AS next_attempt_at FROM customer WHERE c_custkey IS NOT NULL""")
def stream_outbox_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers with a key, which names a file, as files of a queue, half of them and some states first, then the rest, with states written anew; every 7th state is broken."""
    k, root = F.col("c_custkey"), shared_dir(spark)
    folder = f"{root}/queue"
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit(".json"))
    item = c.select(k, name.alias("name"), F.lit("{}").alias("content"))

    def states(tries: int) -> DataFrame:
        said = F.to_json(F.struct(F.lit(tries).alias("attempts"), F.concat(F.lit("later"), k.cast("string")).alias("next_attempt_at")))
        return c.filter(k % 3 <= 0).select(k, F.concat(name, F.lit(queue_files.STATE_SUFFIX)).alias("name"), F.when(k % 7 == 0, "{broken").otherwise(said).alias("content"))

    outbox.use_timers(spark)
    arrivals = (item.filter(k % 2 == 0).unionByName(states(1)), item.filter(k % 2 != 0).unionByName(states(2).filter(k % 2 == 0)))
    for rows in arrivals:
        write_files(rows, folder)

        def keep(found: DataFrame, batch: int) -> None:
            found.withColumn("batch_", F.lit(batch)).write.mode("append").parquet(f"{root}/out")

        stream = queue_files.listing(queue_files.read_queue_stream(spark, folder, settle=0))
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return _last(spark.read.parquet(f"{root}/out"), "name").select("name", "attempts", "next_attempt_at")


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows that each batch wrote, the last of every key."""
    others = [c for c in rows.columns if c not in (*keys, "batch_")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_").alias("r")).select(*keys, "r.*")
