"""Order within groups of any size: places without a task that sees a whole group.

Rows are sorted by group and order over all partitions; a row's place is its place within the partition plus what the group's earlier
partitions hold, one number for each group and partition. The sorted rows are written once, as a second sort might cut them elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import staged


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place_``, their number (from 0) within their group by ``order``; equal rows get places of their own."""
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    cut = staged(ordered.withColumns({"part_": F.spark_partition_id(), "row_": F.monotonically_increasing_id()}), "placed")
    held = cut.groupBy(F.col(group).alias("group_"), "part_").agg(F.min("row_").alias("first_"), F.count("*").alias("n_"))
    before = Window.partitionBy("group_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = held.withColumn("start_", F.coalesce(F.sum("n_").over(before), F.lit(0))).select("group_", F.col("part_").alias("of_"), "first_", "start_")
    joined = cut.join(starts, (F.col("part_") == F.col("of_")) & F.col(group).eqNullSafe(F.col("group_")))
    return joined.withColumn("place_", F.col("row_") - F.col("first_") + F.col("start_")).drop("part_", "row_", "group_", "of_", "first_", "start_")


def ordered_blocks(rows: DataFrame, group: str, order: Sequence[str], value: str, size: int) -> DataFrame:
    """(group, block, items): the values of each group in order, cut into arrays of ``size``. A null value is left out but takes its place."""
    numbered = placed(rows.select(group, *order, F.col(value).alias("value_")), group, order).select(group, "place_", "value_")
    items = F.transform(F.array_sort(F.collect_list(F.struct("place_", F.col("value_").alias("v")))), lambda x: x["v"])
    return numbered.groupBy(group, F.floor(F.col("place_") / size).alias("block")).agg(F.filter(items, lambda v: v.isNotNull()).alias("items"))
