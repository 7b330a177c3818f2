"""Rolled-up numbers of an assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import CLASSES, with_longest


def n50(lengths: DataFrame, column: str = "length", keys: list[str] | None = None) -> DataFrame:
    """First length, in falling order, at which the running sum reaches half; null without any.

    Lengths are counted first, so the window runs over distinct lengths."""
    keys = keys or []
    counted = lengths.where(F.col(column) > 0).groupBy(*keys, column).agg(F.sum(column).alias("bp"))
    w = Window.partitionBy(*keys)
    running = counted.withColumn("cum", F.sum("bp").over(w.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("bp").over(w))
    return running.where(2 * F.col("cum") >= F.col("total")).groupBy(*keys).agg(F.max(column).alias("n50"))


def length_stats(blocks: DataFrame, column: str = "length") -> DataFrame:
    """Lengths are counted before they meet in one task."""
    counted = blocks.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    n, v = F.sum("k"), F.col("v")
    return counted.agg(F.coalesce(n, F.lit(0)).alias("n"), (F.sum(v * F.col("k")) / F.sum(F.when(v.isNotNull(), F.col("k")))).alias("mean"), F.percentile("v", F.lit(0.5), F.col("k")).alias("median"), F.min("v").alias("min"), F.max("v").alias("max"))


def class_counts(summary: DataFrame) -> DataFrame:
    """A row for each of the ten classes, zero where there is none."""
    types = [f"{gap}{c}" for c in CLASSES for gap in ("", "gapped_")]
    every = F.explode(F.array(*map(F.lit, types)))
    names = summary.sparkSession.range(1).select(every.alias("type"))
    return names.join(summary.groupBy("type").agg(F.count("*").alias("n")), "type", "left").fillna(0, ["n"])


def telomere_counts(summary: DataFrame) -> DataFrame:
    """Sequences with two, one, no telomeres; discordant ones are in none of these."""
    plain = F.regexp_replace("type", "^gapped_", "")
    count = lambda *x: F.sum(plain.isin(*x).cast("long"))
    return summary.agg(*(F.coalesce(c, F.lit(0)).alias(n) for n, c in (("two", count("t2t", "misassembly")), ("one", count("incomplete")), ("zero", count("none")))))


def class_shares(summary: DataFrame) -> DataFrame:
    """Share of each class among all and among those with telomeres, in percent."""
    by = summary.groupBy("type").agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    with_telomeres = ~F.col("type").isin("none", "gapped_none")
    return by.select("type", "n", (100.0 * F.col("n") / F.sum("n").over(w)).alias("of_all"), F.when(with_telomeres, 100.0 * F.col("n") / F.sum(F.when(with_telomeres, F.col("n"))).over(w)).alias("of_telomeric"))


def assembly_summary(summary: DataFrame, contigs: DataFrame, blocks: DataFrame, its: DataFrame | None = None, found: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """One row: totals, N50s, statistics of the longest blocks, counts of each class."""
    counts: list[Column] = [F.sum((F.col("type") == f"{g}{c}").cast("long")).alias(f"{g}{c}") for c in CLASSES for g in ("", "gapped_")]
    out = summary.agg(F.count("*").alias("paths"), F.sum("gaps").alias("gaps"), F.sum("telomeres").alias("telomeres"), *counts)
    longest = length_stats(with_longest(blocks).where("is_longest")).select("mean", "median", "min", "max")
    single = lambda df, name: df.agg(F.max("n50").alias(name))
    out = out.join(single(n50(summary, "path_size"), "scaffold_n50")).join(single(n50(contigs, "contig_len"), "contig_n50")).join(longest)
    for df, name in ((its, "its"), (found.where("is_canonical") if found is not None else None, "canonical_matches"), (windows, "windows")):
        if df is not None:
            out = out.join(df.agg(F.count("*").alias(name)))
    return out.fillna(0)
