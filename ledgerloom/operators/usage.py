"""The usage ledger: one row an event, cumulative totals a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedupe(rows: DataFrame, key: str = "event_id", order: str = "ord") -> DataFrame:
    """The first row of each event."""
    first = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("n_", F.row_number().over(first)).filter("n_ = 1").drop("n_")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest row of each key: totals replace earlier ones, they never add up. A pre-aggregated argmax, so a hot key costs one row a task."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r_"))
    return best.select(key, *(F.col(f"r_.{c}").alias(c) for c in others)).select(rows.columns)


def upsert(table: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``table`` with the rows merged in: of each key the latest stays."""
    return latest(table.unionByName(rows), key, *order)
