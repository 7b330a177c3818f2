"""Matches into blocks: terminal ones for each strand of a contig, interstitial ones between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.columns import strand_label
from .islands import gap_above, hull_breaks, islands, within
from .matches import KEYS, TILE

CONTIG = ["seq_pos", "header", "contig_no"]
COUNTS = ["forward_count", "reverse_count", "canonical_count", "noncanonical_count", "covered", "forward_covered", "canonical_covered"]


def _folds() -> list[Column]:
    forward, canonical, n = F.col("is_forward"), F.col("is_canonical"), F.col("len").cast("long")
    one = lambda c: F.sum(c.cast("long"))
    return [
        F.min("pos").alias("start"),
        F.max("pos").alias("last_pos"),
        F.max_by(F.col("pos") + F.col("len"), F.struct("pos", "len")).alias("end"),  # of the last match, not the furthest
        F.count("*").alias("n"),
        one(forward).alias("forward_count"),
        one(~forward).alias("reverse_count"),
        one(canonical).alias("canonical_count"),
        one(~canonical).alias("noncanonical_count"),
        F.sum(n).alias("covered"),
        F.sum(F.when(forward, n).otherwise(0)).alias("forward_covered"),
        F.sum(F.when(canonical, n).otherwise(0)).alias("canonical_covered"),
    ]


def _refolds() -> list[Column]:
    """Folds of folds of runs in order."""
    return [F.min("start").alias("start"), F.max("last_pos").alias("last_pos"), F.max_by("end", "last_pos").alias("end"), *(F.sum(x).alias(x) for x in ("n", *COUNTS))]


def runs(found: DataFrame, keys: list[str], c: ScanConfig, stretch: int = TILE) -> DataFrame:
    """``keys``, those of the contig and the folds of each run of matches whose starts lie within the match distance.

    Runs are folded within stretches of a contig first, so no task holds all matches of one; what is left of a
    stretch, which is less the denser its matches, is then joined to its neighbours'."""
    inner = [*keys, "stretch"]
    placed = found.withColumn("stretch", F.floor(F.col("pos") / stretch))
    placed = placed.withColumn("breaks", gap_above("pos", inner, ["pos", "len"], c.max_match_distance))
    names = list(dict.fromkeys([*KEYS, *keys]))
    parts = islands(placed, inner, ["pos", "len"], F.col("breaks"), "part").groupBy(*names, "stretch", "part").agg(*_folds())
    before = F.lag("last_pos").over(within(keys, ["start"]))
    parts = parts.withColumn("breaks", before.isNull() | (F.col("start") - before > c.max_match_distance))
    return islands(parts, keys, ["start"], F.col("breaks")).groupBy(*names, "island").agg(*_refolds())


def strand_islands(found: DataFrame, c: ScanConfig) -> DataFrame:
    """Runs of matches of one strand; before any filter."""
    return runs(found.withColumn("strand", F.col("is_forward")), [*CONTIG, "strand"], c)


def terminal_blocks(found: DataFrame, c: ScanConfig) -> DataFrame:
    """``header, label, start, end, ...`` in coordinates of the sequence, with counts, ``valid_orientation``.

    p blocks come from forward matches, q blocks from reverse ones.  Islands must begin (as seen from their end) in the
    terminal zone and be canonical and dense enough; those left merge over the block distance, and the hull must be long
    enough.  Orientation is valid if the block lies nearer to the end that its strand belongs to."""
    t, n = c.terminal_limit, F.col("contig_len")
    every = strand_islands(found, c)
    zone = F.when(F.col("strand"), F.col("start") < t).otherwise(F.col("last_pos") >= n - t) | (n <= t)
    dense = F.col("canonical_covered").cast("float") >= F.lit(c.min_block_density).cast("float") * (F.col("end") - F.col("start")).cast("float")
    good = every.where(zone & (F.col("n") >= c.min_matches) & (F.col("canonical_count") > 0) & dense)
    keys = [*CONTIG, "strand"]
    flagged = good.withColumn("breaks", hull_breaks("start", "end", keys, ["start", "end"], c.max_block_distance))
    merged = islands(flagged, keys, ["start", "end"], F.col("breaks"), "block").groupBy(*KEYS, "strand", "block").agg(F.min("start").alias("a"), F.max_by("end", "start").alias("b"), *(F.sum(x).alias(x) for x in COUNTS))
    left, right = F.col("a"), F.col("contig_len") - F.col("b")
    kept = merged.where(F.col("b") - F.col("a") >= c.min_block_length)
    return kept.select(
        "seq_pos", "header", "path_size", "contig_no", "contig_start", "contig_len",
        F.when(F.col("strand"), "p").otherwise("q").alias("label"),
        (F.col("contig_start") + F.col("a")).alias("start"),
        (F.col("contig_start") + F.col("b")).alias("end"),
        (F.col("b") - F.col("a")).alias("length"),
        *COUNTS,
        F.when(F.col("strand"), left <= right).otherwise(left >= right).alias("valid_orientation"),
    )


def with_terminality(blocks: DataFrame, limit: int) -> DataFrame:
    """Adds ``scaffold_terminal``: within the limit of an end of the whole sequence."""
    beyond = F.col("end") > F.greatest(F.col("path_size") - limit, F.lit(0)) if limit < 1 << 31 else F.lit(True)
    return blocks.withColumn("scaffold_terminal", (F.col("start") < limit) | beyond)


def boundaries(contigs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where each contig's inner part begins and ends: after its last p block, before its first q block."""
    inner = blocks.groupBy(*CONTIG).agg(F.max(F.when(F.col("label") == "p", F.col("end"))).alias("p_end"), F.min(F.when(F.col("label") == "q", F.col("start"))).alias("q_start"))
    whole = contigs.select(*CONTIG, "contig_start", "contig_len").join(inner, CONTIG, "left")
    return whole.select(*CONTIG, F.coalesce("p_end", "contig_start").alias("inner_start"), F.coalesce("q_start", F.col("contig_start") + F.col("contig_len")).alias("inner_end"))


def interstitial_blocks(found: DataFrame, contigs: DataFrame, blocks: DataFrame, c: ScanConfig) -> DataFrame:
    """Runs of matches of both strands between the boundaries, long and canonical enough; labelled by strand share."""
    inner = boundaries(contigs, blocks).where("inner_start < inner_end")
    between = found.join(inner, CONTIG).where((F.col("abs_pos") >= F.col("inner_start")) & (F.col("abs_pos") < F.col("inner_end")))
    first = c.expanded()[0].length if c.expanded() else 0
    kept = runs(between, CONTIG, c).where((F.col("end") - F.col("start") >= 2 * first) & (F.col("canonical_count") >= 4) & (F.col("n") >= 2))
    return kept.select("seq_pos", "header", "path_size", "contig_no", strand_label(F.col("forward_count"), F.col("n")).alias("label"), (F.col("contig_start") + F.col("start")).alias("start"), (F.col("contig_start") + F.col("end")).alias("end"), (F.col("end") - F.col("start")).alias("length"), *COUNTS)
