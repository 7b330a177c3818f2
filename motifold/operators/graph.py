"""Caps on the ends of assembly graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ScanConfig
from . import blocks as B
from . import matches as M


def segment_blocks(segments: DataFrame, c: ScanConfig) -> DataFrame:
    """Terminal blocks of whole segments (``segment, seq``), gaps or not; null sequences have none."""
    s = segments.where("seq is not null and seq <> '*'").select("segment", F.upper("seq").alias("bases"))
    size = F.length("bases").cast("long")
    whole = s.select(F.lit(0).cast("long").alias("seq_pos"), F.col("segment").alias("header"), size.alias("path_size"), F.lit(0).alias("contig_no"), F.lit(0).cast("long").alias("contig_start"), size.alias("contig_len"), "bases")
    found = M.in_tips(M.matches(whole, c.expanded()), c.terminal_limit)
    return B.terminal_blocks(found, c).select(F.col("header").alias("segment"), "start", "end", "length", (F.col("start") <= F.col("path_size") - F.col("end")).alias("at_start"))


def caps(segments: DataFrame, c: ScanConfig, ends: DataFrame | None = None) -> DataFrame:
    """``node, segment, role, path_orient, link_orient, length``: nodes to add; of several blocks at an end the longest.

    ``ends`` (``ref_id, orient, is_first``) are the ends of paths, each once; without paths every segment counts."""
    found = segment_blocks(segments, c)
    if ends is None:
        role = F.when(F.col("at_start"), "start").otherwise("end")
        named = found.select(F.concat(F.lit("telomere_"), "segment", F.lit("+_"), role).alias("node"), "segment", role.alias("role"), F.lit(".").alias("path_orient"), F.when(F.col("at_start"), "+").otherwise("-").alias("link_orient"), "length")
    else:
        e = ends.select(F.col("ref_id").alias("segment"), "orient", "is_first").distinct()
        met = found.join(e, "segment").where(F.col("at_start") == (F.col("is_first") == (F.col("orient") == "+")))
        role = F.when(F.col("is_first"), "start").otherwise("end")
        flip = F.when(F.col("orient") == "+", "-").otherwise("+")
        named = met.select(F.concat(F.lit("telomere_"), "segment", "orient", F.lit("_"), role).alias("node"), "segment", role.alias("role"), F.col("orient").alias("path_orient"), F.when(F.col("is_first"), F.col("orient")).otherwise(flip).alias("link_orient"), "length")
    return named.groupBy("node", "segment", "role", "path_orient", "link_orient").agg(F.max("length").alias("length"))


def cap_lines(found: DataFrame) -> DataFrame:
    """``rank, node, line``: segment and link lines of caps."""
    s = F.concat(F.lit("S\t"), "node", F.lit("\t*\tLN:i:6\tRC:i:6000\tTL:i:"), F.col("length").cast("string"))
    l = F.concat(F.lit("L\t"), "node", F.lit("\t+\t"), "segment", F.lit("\t"), "link_orient", F.lit("\t0M\tRC:i:0"))  # noqa: E741
    return found.select(F.lit(1).alias("rank"), "node", s.alias("line")).union(found.select(F.lit(2), "node", l))
