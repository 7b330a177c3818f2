"""Fixed windows along contigs: matches that lie wholly in them, bases, and ratios of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import base_count, entropy, gc_percent, ratio
from .matches import pieces

KEYS = ["seq_pos", "header", "contig_no"]


def windows(contigs: DataFrame, window: int, step: int) -> DataFrame:
    """``window_no, start, end`` (of the sequence), ``size`` and base counts; short windows at the end stay."""
    cut = pieces(contigs.where("contig_len > 0"), [*KEYS, "path_size", "contig_start"], step, window)
    size = F.length("bases").cast("long")
    start = F.col("contig_start") + F.col("piece_start")
    return cut.select(*KEYS, "path_size", F.col("piece").alias("window_no"), start.alias("start"), (start + size).alias("end"), size.alias("size"), *(base_count(F.col("bases"), b).alias(f"n_{b.lower()}") for b in "ACGT"))


def covered_windows(contigs: DataFrame, found: DataFrame, window: int, step: int) -> DataFrame:
    """Windows with what their matches cover.  A match knows the numbers of the windows that hold it, so it is an equi-join."""
    last = F.floor(F.col("pos") / step).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") + F.col("len") - window) / step)).cast("int")
    n, forward, canonical = F.col("len").cast("long"), F.col("is_forward"), F.col("is_canonical")
    held = found.where(first <= last).withColumn("window_no", F.explode(F.sequence(first, last)))
    sums = held.groupBy(*KEYS, "window_no").agg(
        F.sum(F.when(forward, n).otherwise(0)).alias("forward_covered"), F.sum(F.when(~forward, n).otherwise(0)).alias("reverse_covered"),
        F.sum(F.when(canonical, n).otherwise(0)).alias("canonical_covered"), F.sum(F.when(~canonical, n).otherwise(0)).alias("noncanonical_covered"),
        F.sum(canonical.cast("long")).alias("canonical_count"), F.sum((~canonical).cast("long")).alias("noncanonical_count"),
    )
    added = ["forward_covered", "reverse_covered", "canonical_covered", "noncanonical_covered", "canonical_count", "noncanonical_count"]
    return windows(contigs, window, step).join(sums, [*KEYS, "window_no"], "left").fillna(0, added)


def metrics(w: DataFrame) -> DataFrame:
    """Density, canonical ratio and strand ratio (-1 where nothing is covered), GC percent, entropy."""
    size = F.col("size")
    return w.select(
        *KEYS, "path_size", "window_no", "start", "end", "size", "canonical_count", "noncanonical_count",
        ((F.col("forward_covered") + F.col("reverse_covered")) / size).alias("density"),
        ratio(F.col("canonical_covered"), F.col("noncanonical_covered")).alias("canonical_ratio"),
        ratio(F.col("forward_covered"), F.col("reverse_covered")).alias("strand_ratio"),
        gc_percent(F.col("n_c"), F.col("n_g"), size).alias("gc"),
        entropy([F.col(f"n_{b}") for b in "acgt"], size).alias("entropy"),
    )
