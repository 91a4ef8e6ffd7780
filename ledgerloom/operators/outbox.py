"""Durable delivery: what is due, what becomes of a try, and the state of the queue.

The transition is a pure function of an item's state and a delivery's status, so a batch run and the
streaming form (``streaming.delivery``) share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.scalars import MOST_ATTEMPTS, backoff_seconds, retryable
from ledgerloom.functions.text import cut

# Fixed values of delivery: sends a run, UTF-16 units of an error.
SENDS, MOST_ERROR = 25, 300


def due(next_attempt_at: Column, now: Column) -> Column:
    """A time that can't be read counts as due."""
    return F.coalesce(F.try_to_timestamp(next_attempt_at) <= now, F.lit(True))


def outcome(readable: Column, status: Column, attempts: Column, most: int = MOST_ATTEMPTS) -> Column:
    """delivered, retrying or quarantined. A delivery that threw has status 0."""
    tried = attempts + 1
    return F.when(~readable, "quarantined").when(status.between(200, 299), "delivered").when(retryable(status) & (tried < most), "retrying").otherwise("quarantined")


def drain(items: DataFrame, now: Column, limit: int = SENDS, most: int = MOST_ATTEMPTS, group: str = "queue") -> DataFrame:
    """Items with their ``outcome`` and next state. Each queue sends up to ``limit`` due items by name; items not due or unreadable don't use it up.

    ``items``: queue, name (once a queue), attempts, next_attempt_at, readable, status (of the delivery, were it tried), and if known its error.
    The name of a queue's last send comes from its ``limit`` least names, of which each task keeps no more; no task sorts a queue.
    """
    is_due = due(F.col("next_attempt_at"), now)
    sendable = is_due & F.col("readable")
    least = items.filter(sendable).select(F.col(group).alias("group_"), "name").withColumn("nth_", F.row_number().over(Window.partitionBy("group_").orderBy("name")))
    ends = least.filter(F.col("nth_") <= limit).groupBy("group_").agg(F.max("name").alias("end_"), F.count("*").alias("sends_")).filter(F.col("sends_") >= limit)
    after = F.lit(True) if limit < 1 else F.coalesce(F.col("name") > F.col("end_"), F.lit(False))
    result = F.when(after, "waiting").when(~is_due, "deferred").otherwise(outcome(F.col("readable"), F.col("status"), F.col("attempts"), most))
    stepped = items.join(ends, items[group].eqNullSafe(F.col("group_")), "left").withColumn("outcome", result).drop("group_", "end_", "sends_")
    tried = F.col("outcome").isin("retrying", "quarantined") & F.col("readable")
    wait = F.when(F.col("outcome") == "retrying", backoff_seconds(F.col("next_attempts")))
    stepped = stepped.withColumn("next_attempts", F.col("attempts") + tried.cast("int")).withColumn("wait_seconds", wait)
    failed = F.col("outcome").isin("retrying", "quarantined")
    error = cut(F.col("error"), MOST_ERROR) if "error" in items.columns else F.lit(None).cast("string")
    return stepped.withColumns({
        "last_status": F.when(tried, F.col("status")), "last_error": F.when(failed, F.coalesce(error, F.when(~F.col("readable"), "unreadable item"))),
        "next_due": F.when(F.col("outcome") == "retrying", now + F.make_dt_interval(secs=F.col("wait_seconds").cast("decimal(18,6)"))),
    })


def report(drained: DataFrame, *group: str) -> DataFrame:
    """Counts of delivered, retrying, quarantined and deferred items."""
    return drained.groupBy(*group).agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in ("delivered", "retrying", "quarantined", "deferred")))


def status(pending: DataFrame, quarantined: DataFrame, now: Column) -> DataFrame:
    """Pending and due items, quarantined ones, the oldest day, and the last error by name."""
    one = pending.agg(
        F.count("*").alias("pending"),
        F.count_if(due(F.col("next_attempt_at"), now)).alias("due"),
        F.substring(F.min("name"), 1, 10).alias("oldest"),
        F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("name"))).alias("last_error"),
    )
    return one.crossJoin(quarantined.agg(F.count("*").alias("quarantined")))  # one row beside one row


def health(outbox_status: DataFrame) -> DataFrame:
    """quarantined before backlog before ok."""
    return outbox_status.withColumn("health", F.when(F.col("quarantined") > 0, "quarantined").when(F.col("pending") > 0, "backlog").otherwise("ok"))


def rollup(checks: DataFrame, *group: str) -> DataFrame:
    """needs_login if any check says so, degraded if any failed, else ok."""
    return checks.groupBy(*group).agg(F.when(F.bool_or(F.col("state") == "needs_login"), "needs_login").when(F.bool_or(F.col("state") == "failed"), "degraded").otherwise("ok").alias("health"))


def revoked(status_code: Column) -> Column:
    """Aggregate: whether a delivery was ever refused for its credentials."""
    return F.bool_or(status_code.isin(401, 403))
