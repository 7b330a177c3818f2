"""Sequences into contigs and gaps.  A gap is a maximal run of N or X; all else is contig."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = "[NX]+"


def components(sequences: DataFrame) -> DataFrame:
    """``header, seq_pos, path_size, idx, kind, start, end, bases``: parts of each sequence in order.

    ``sequences`` has ``seq_pos, header, seq``; null is an empty sequence, which has no parts."""
    s = sequences.select("seq_pos", "header", F.upper(F.coalesce("seq", F.lit(""))).alias("seq")).withColumn("path_size", F.length("seq").cast("long"))
    parts = F.arrays_zip(F.split("seq", GAP, -1).alias("bases"), F.regexp_extract_all("seq", F.lit(GAP), F.lit(0)).alias("gap"))
    flat = s.select("seq_pos", "header", "path_size", F.posexplode(parts).alias("n", "x")).select("seq_pos", "header", "path_size", F.col("n").alias("idx"), "x.bases", F.coalesce("x.gap", F.lit("")).alias("gap"))
    long = F.length("bases") + F.length("gap")
    before = F.sum(long).over(Window.partitionBy("seq_pos", "header").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    flat = flat.withColumn("at", F.coalesce(before, F.lit(0)).cast("long"))
    contig = F.struct(F.lit("S").alias("kind"), F.col("at").alias("start"), (F.col("at") + F.length("bases")).alias("end"), F.col("bases").alias("bases"))
    gap = F.struct(F.lit("G").alias("kind"), (F.col("at") + F.length("bases")).alias("start"), (F.col("at") + long).alias("end"), F.lit("").alias("bases"))
    return flat.select("seq_pos", "header", "path_size", "idx", F.explode(F.array(contig, gap)).alias("p")).select("seq_pos", "header", "path_size", "idx", "p.*").where("end > start")


def contigs(parts: DataFrame) -> DataFrame:
    return parts.where("kind = 'S'").select("seq_pos", "header", "path_size", F.col("idx").alias("contig_no"), F.col("start").alias("contig_start"), (F.col("end") - F.col("start")).alias("contig_len"), "bases")


def gaps(parts: DataFrame) -> DataFrame:
    return parts.where("kind = 'G'").select("seq_pos", "header", "start", "end")


def path_walk(paths: DataFrame, segments: DataFrame, jumps: DataFrame) -> DataFrame:
    """Offsets along paths: ``paths(path_id, idx, kind, ref_id, orient)`` with sizes from ``segments(ref_id, length)`` and
    ``jumps(ref_id, length)``; a part whose size isn't known has none."""
    sizes = segments.select(F.lit("S").alias("kind"), "ref_id", "length").union(jumps.select(F.lit("G").alias("kind"), "ref_id", "length"))
    sized = paths.join(sizes, ["kind", "ref_id"], "left").withColumn("length", F.coalesce("length", F.lit(0)).cast("long"))
    before = F.sum("length").over(Window.partitionBy("path_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return sized.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")).withColumn("end", F.col("start") + F.col("length"))


def path_ends(paths: DataFrame) -> DataFrame:
    """First and last oriented segment of each path: ``ref_id, orient, is_first``, each once."""
    s = paths.where("kind = 'S' and orient in ('+', '-')").groupBy("path_id").agg(F.min_by(F.struct("ref_id", "orient"), "idx").alias("a"), F.max_by(F.struct("ref_id", "orient"), "idx").alias("b"))
    ends = F.array(F.struct(F.col("a.ref_id"), F.col("a.orient"), F.lit(True).alias("is_first")), F.struct(F.col("b.ref_id"), F.col("b.orient"), F.lit(False).alias("is_first")))
    return s.select(F.explode(ends).alias("e")).select("e.ref_id", "e.orient", "e.is_first").distinct()
