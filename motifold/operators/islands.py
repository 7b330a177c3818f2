"""Gaps and islands: rows in order, a new island where the gap to the row before is too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Adds the number of each row's island; ``breaks`` may use lag(...) over the rows of a key, by order.

    ``breaks`` is a column over the window that ``within`` gives."""
    w = within(keys, order)
    return rows.withColumn(name, F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def within(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def gap_above(value: str, keys: list[str], order: list[str], most: int) -> Column:
    """The row's value lies more than ``most`` above that of the row before; true for the first."""
    before = F.lag(value).over(within(keys, order))
    return before.isNull() | (F.col(value) - before > most)


def hull_breaks(start: str, end: str, keys: list[str], order: list[str], most: int) -> Column:
    """From the end before to this start it is more than ``most``, or less than nothing."""
    gap = F.col(start) - F.lag(end).over(within(keys, order))
    return gap.isNull() | (gap < 0) | (gap > most)


def clusters(rows: DataFrame, keys: list[str], start: str, end: str, merge_gap: int) -> DataFrame:
    """Intervals that overlap, or lie within ``merge_gap`` of what was before: hull, summed length, count."""
    order = [start, end]
    reach = F.max(end).over(within(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("_cluster_breaks", reach.isNull() | (F.col(start) - reach > merge_gap))
    numbered = islands(flagged, keys, order, F.col("_cluster_breaks"), "cluster")
    return numbered.groupBy(*keys, "cluster").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.sum(F.col(end) - F.col(start)).alias("bp"), F.count("*").alias("n"))
