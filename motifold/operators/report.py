"""What a report shows, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import end_distance
from .islands import clusters

# Classes that a report points out.
FLAGGED = ("misassembly", "gapped_misassembly", "discordant", "gapped_discordant")


def chrom_sizes(blocks: DataFrame, *series: DataFrame) -> DataFrame:
    """Largest of stated sizes and of ends of blocks and series: ``chrom, size``."""
    ends = blocks.select("chrom", F.greatest(F.col("path_size"), F.col("end")).alias("size"))
    for s in series:
        ends = ends.unionAll(s.select("chrom", F.col("end").alias("size")))
    return ends.groupBy("chrom").agg(F.max("size").alias("size"))


def block_rows(blocks: DataFrame, sizes: DataFrame, limit: int = 1000) -> DataFrame:
    """Blocks with size, distance from their end, and whether that flags them."""
    b = blocks.join(sizes, "chrom", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    d = end_distance(F.col("label"), F.col("start"), F.col("end"), F.col("size"))
    return b.withColumn("distance", d).withColumn("flagged", d > limit)


def flagged_scaffolds(classes: DataFrame, sizes: DataFrame, most: int = 10) -> DataFrame:
    """Largest scaffolds of the flagged classes."""
    s = classes.join(sizes, "chrom", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return s.where(F.col("type").isin(*FLAGGED) & (F.col("size") > 0)).orderBy(F.desc("size"), "chrom").limit(most)


def flagged_by_scaffold(rows: DataFrame, most: int = 10) -> DataFrame:
    """Flagged blocks of each scaffold: summed length, count, the commonest label (the first of several)."""
    f = rows.where("flagged")
    arm = f.groupBy("chrom", "label").agg(F.count("*").alias("k"), F.min("start").alias("at")).groupBy("chrom").agg(F.max_by("label", F.struct("k", -F.col("at"))).alias("arm"))
    return f.groupBy("chrom").agg(F.sum("length").alias("bp"), F.count("*").alias("n")).join(arm, "chrom").orderBy(F.desc("bp"), "chrom").limit(most)


def outliers(values: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``outlier``: beyond 1.5 interquartile ranges, where there are four values or more that differ."""
    keys = keys or []
    counted = values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_k"))  # before values meet in one task
    q = counted.groupBy(*keys).agg(F.sum("_k").alias("_n"), F.percentile("_v", F.array(F.lit(0.25), F.lit(0.75)), F.col("_k")).alias("_q"), (F.max("_v") - F.min("_v")).alias("_range"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    iqr = high - low
    joined = values.join(q, keys, "left") if keys else values.join(q, how="left")
    out = (F.col("_n") >= 4) & (F.col("_range") > 0) & (iqr > 0) & ((F.col(column) < low - 1.5 * iqr) | (F.col(column) > high + 1.5 * iqr))
    return joined.withColumn("outlier", F.coalesce(out, F.lit(False))).drop("_n", "_q", "_range")


def view_windows(blocks: DataFrame) -> DataFrame:
    """``chrom, p_start, p_end, q_start, q_end``: how much of each end to show.

    An arm's limit is twice how far its blocks (b blocks are of both) reach from the end, 1 kb at least, whole kb, at most
    the chromosome.  Limits of which one is at most five times the other become the larger; an arm without blocks takes
    the other's.  Without a size or p, q and b blocks there is no view."""
    size, label = F.col("path_size"), F.col("label")
    far = lambda labels, reach: F.max(F.when(label.isin(*labels), F.greatest(reach, F.lit(0))))
    r = blocks.groupBy("chrom").agg(F.max(size).alias("size"), far("pb", F.greatest("start", "end")).alias("p"), far("qb", F.greatest(size - F.col("end"), size - F.col("start"))).alias("q"))
    z = F.col("size")
    kb = lambda c: F.when(c.isNotNull() & (z > 0), F.when(z <= 1000, z).otherwise(F.least(z, F.ceil(F.least(z, F.greatest(2 * c, F.lit(1000))) / 1000) * 1000)))
    w = r.withColumn("pw", kb(F.col("p"))).withColumn("qw", kb(F.col("q")))
    more, less = F.greatest("pw", "qw"), F.least("pw", "qw")
    shared = F.col("pw").isNull() | F.col("qw").isNull() | (more <= 5 * less)
    w = w.withColumn("pv", F.when(shared, more).otherwise(F.col("pw"))).withColumn("qv", F.when(shared, more).otherwise(F.col("qw"))).where("pv is not null")
    return w.select("chrom", F.lit(0).cast("long").alias("p_start"), F.col("pv").cast("long").alias("p_end"), F.greatest(z - F.col("qv"), F.lit(0)).cast("long").alias("q_start"), z.cast("long").alias("q_end"))


def best_cluster(its: DataFrame, merge_gap: int = 50_000) -> DataFrame:
    """The cluster of interstitial blocks with most bases, on each chromosome the first of equals."""
    c = clusters(its, ["chrom"], "start", "end", merge_gap)
    return c.groupBy("chrom").agg(F.max_by(F.struct("start", "end", "bp", "n"), F.struct("bp", -F.col("start"))).alias("c")).select("chrom", "c.*")


def true_runs(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """First and last place of each run of rows whose flag is true."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = F.sum((~F.col(flag)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", run).where(flag).groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))
