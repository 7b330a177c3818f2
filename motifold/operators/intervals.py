"""Joins of half-open intervals, and the evaluation of calls against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, key: str, bin_size: int = 1 << 14, how: str = "inner") -> DataFrame:
    """Pairs of equal key with ``a.start < b.end and b.start < a.end``; columns of b get the prefix ``b_``.

    Both sides are dealt to bins of the coordinate, so the join is an equi-join whose partitions stay small; a pair
    counts in the bin where the later of both begins.  ``left_semi`` and ``left_anti`` keep or drop rows of a."""
    if how != "inner":
        row = a.withColumn("_row", F.monotonically_increasing_id())
        hit = overlap_join(row, b, key, bin_size).select("_row").distinct()
        return row.join(hit, "_row", how).drop("_row")
    bins = lambda s, e: F.explode(F.sequence((s / bin_size).cast("long"), (F.greatest(s, e - 1) / bin_size).cast("long")))
    left = a.where("start < end").withColumn("_bin", bins(F.col("start"), F.col("end")))
    right = b.where("start < end").select(*(F.col(c).alias(c if c == key else f"b_{c}") for c in b.columns)).withColumn("_bin", bins(F.col("b_start"), F.col("b_end")))
    first = (F.greatest("start", "b_start") / bin_size).cast("long")
    return left.join(right, [key, "_bin"]).where((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")) & (F.col("_bin") == first)).drop("_bin")


def not_overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return overlap_join(a, b, key, how="left_anti")


def evaluation(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: how many true intervals are called, length errors of those, calls without truth.

    ``truth``: chrom, arm, start, end; ``calls``: chrom, label, start, end.  A truth is met by the overlapping calls of
    its arm, of which the longest counts; means over nothing are null."""
    t = truth.withColumn("row", F.monotonically_increasing_id())
    met = overlap_join(t, calls, "chrom").where(F.col("arm") == F.col("b_label"))
    best = met.groupBy("row").agg(F.max(F.col("b_end") - F.col("b_start")).alias("called"))
    both = t.join(best, "row", "left").withColumn("error", F.col("called") - (F.col("end") - F.col("start")))
    false = not_overlapping(calls, truth, "chrom").agg(F.count("*").alias("false_positives"))
    n = F.count("*")
    return both.agg(n.alias("truths"), F.count("called").alias("found"), F.when(n > 0, F.count("called") / n).alias("sensitivity"), F.avg("error").alias("mean_bias"), F.avg(F.abs("error")).alias("mean_absolute_error")).join(false)


def clipped(series: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """Intervals cut to a view; those outside go."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return series.where((F.col("end") > a) & (F.col("start") < b)).withColumns({"start": F.greatest(F.col("start"), a), "end": F.least(F.col("end"), b)})
