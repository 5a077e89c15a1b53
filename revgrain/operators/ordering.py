"""Running totals and previous values over one global order, without a single-task window.

Rows are range-partitioned by the order and written to the shared checkpoint folder together with their partition
number. Each partition is then scanned on its own, and what crosses a border comes from a summary of one row per
partition. A key that holds most of the rows is split like any other range, because the order ends in a unique column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from revgrain.session import cut_lineage


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``_pid``, the number of their range partition in the given order."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and including this one. ``order`` must be unique."""
    rows = ranged(df, order)
    totals = rows.groupBy("_pid").agg(F.sum(value).alias("_sum"))  # one row per partition
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_part", F.sum(value).over(inside)).join(F.broadcast(offsets), "_pid")
    return summed.withColumn(out, F.col("_part") + F.col("_offset")).drop("_pid", "_part", "_offset")


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``value`` of the row before this one in the order of its key, null for a key's first row."""
    full = [*keys, *order]
    rows = ranged(df, full)
    state = F.struct(*full, value)
    last = rows.groupBy("_pid").agg(F.max_by(state, F.struct(*full)).alias("_last"))  # one row per partition
    borders = last.select("_pid", F.lag("_last").over(Window.orderBy("_pid")).alias("_border"))
    inside = Window.partitionBy("_pid").orderBy(*full)
    rows = rows.withColumn("_before", F.lag(state).over(inside)).join(F.broadcast(borders), "_pid")
    before = F.coalesce("_before", "_border")
    same: Column = F.lit(True)
    for k in keys:
        same = same & (before[k] == F.col(k))
    return rows.withColumn(out, F.when(same, before[value])).drop("_pid", "_before", "_border")
