"""What figures draw, as tables and columns: series as seen from an arm's end, values, axes, labels in a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_join

# Least share of a view that a block's glyph takes, by label.
GLYPH_SHARE = {"p": 0.018, "q": 0.018, "b": 0.030}
# Steps of an axis, and spans from which it counts in kbp and Mbp.
TICKS, KBP_SPAN, MBP_SPAN = 5, 2_000, 2_000_000


def terminal_interval(arm: Column, start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """Start and end as distances from the arm's end, mirrored for q; as they are for other arms."""
    zero = F.lit(0).cast("long")
    a = F.when(arm == "p", F.greatest(start, zero)).when(arm == "q", F.greatest(size - end, zero)).otherwise(start)
    b = F.when(arm == "p", F.greatest(end, zero)).when(arm == "q", F.greatest(size - start, zero)).otherwise(end)
    return a, b


def projected(series: DataFrame, arm: Column, size: Column) -> DataFrame:
    """``start, end`` of a series as its arm's panel has them: those of q run from the chromosome's end."""
    mirrored = arm == "q"
    return series.withColumns({"start": F.when(mirrored, size - F.col("end")).otherwise(F.col("start")), "end": F.when(mirrored, size - F.col("start")).otherwise(F.col("end"))})


def step_points(series: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, x, y``: a point at each start, values below 0 drawn as 0, and one at the last end, its value as it is."""
    points = series.select(*keys, F.col("start").alias("x"), F.greatest(F.col("value"), F.lit(0.0)).alias("y"))
    last = series.groupBy(*keys).agg(F.max_by(F.struct(F.col("end").alias("x"), F.col("value").alias("y")), F.struct("start", "end")).alias("p")).select(*keys, "p.*")
    return points.unionByName(last)


def log_plus(x: Column) -> Column:
    """log10(x + 1)."""
    return F.log10(x + 1)


def gc_fraction(percent: Column) -> Column:
    return percent / 100.0


def valid_value(value: Column) -> Column:
    """Finite and not negative; what isn't stands for no data."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < F.lit(float("inf")))


def labels_in_view(blocks: DataFrame, start: Column, end: Column) -> DataFrame:
    """``chrom, label``: which labels a legend needs for blocks that reach into the view."""
    return blocks.where((F.col("end") > start) & (F.col("start") < end)).select("chrom", "label").distinct()


def merged_panels(blocks: DataFrame, views: DataFrame) -> DataFrame:
    """``chrom, merged``: one panel for both ends where their windows meet and both arms have blocks, or no arm has any."""
    arm = lambda labels: F.max(F.col("label").isin(*labels))
    has = blocks.groupBy("chrom").agg(arm("pb").alias("p"), arm("qb").alias("q"))
    meet = F.col("p_end") >= F.col("q_start")
    return has.join(views, "chrom", "left").select("chrom", (F.col("p_end").isNull() | meet & F.col("p") & F.col("q")).alias("merged"))


def glyph_fits(label: Column, width: Column, span: Column) -> Column:
    """Whether a block is wide enough in its view for its glyph."""
    least = F.create_map(*(F.lit(x) for kv in GLYPH_SHARE.items() for x in kv))[label]
    return F.coalesce((span > 0) & (width / span >= least), F.lit(False))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\.?0+$", "")


def axis_ticks(start: Column, end: Column, arm: Column) -> Column:
    """Array of (at, text): TICKS places from start to end; kbp from the end for arms, else bp, kbp or Mbp by the span."""
    span = (end - start).cast("double")
    terminal, n = arm.isin("p", "q"), TICKS - 1

    def tick(i: Column) -> Column:
        at = start + span * i / n
        kbp = F.greatest(span, F.lit(1.0)) / 1e3 * i / n
        along = F.when(span >= MBP_SPAN, F.call_function("format_number", at / 1e6, F.lit("0.0"))).when(span >= KBP_SPAN, F.bround(F.greatest(at, F.lit(0.0)) / 1e3).cast("long").cast("string")).otherwise(F.bround(F.greatest(at, F.lit(0.0))).cast("long").cast("string"))
        return F.struct(at.alias("at"), F.when(terminal, _trimmed(F.call_function("format_number", kbp, F.lit("0.00")))).otherwise(along).alias("text"))

    return F.when(end > start, F.transform(F.sequence(F.lit(0), F.lit(n)), tick))


def by_size(sizes: DataFrame) -> DataFrame:
    """``chrom, size`` of those with a size, the largest first, then by name: a range sort, which no single task does."""
    return sizes.where("size > 0").select("chrom", "size").orderBy(F.desc("size"), "chrom")


def without_size(names: DataFrame, sizes: DataFrame) -> DataFrame:
    """Chromosomes with blocks that no size is known of."""
    return names.select("chrom").distinct().join(sizes.where("size > 0").select("chrom"), "chrom", "left_anti")


def category_union(classes: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Chromosomes of any of the categories, each once."""
    return classes.where(F.col("type").isin(*categories)).select("chrom").distinct()


def all_blocks(terminal: DataFrame, interstitial: DataFrame) -> DataFrame:
    """Terminal and interstitial blocks by chromosome, with which they are."""
    columns = ["chrom", "label", "start", "end"]
    return terminal.select(*columns, F.lit("terminal").alias("kind")).unionByName(interstitial.select(*columns, F.lit("interstitial").alias("kind")))


def bp_short(n: Column) -> Column:
    """``1.23 Mb``, ``4.5 kb``, ``678 bp``."""
    return F.when(n >= 1_000_000, F.concat(F.call_function("format_number", n / 1e6, F.lit("0.00")), F.lit(" Mb"))).when(n >= 1000, F.concat(F.call_function("format_number", n / 1e3, F.lit("0.0")), F.lit(" kb"))).otherwise(F.concat(n.cast("string"), F.lit(" bp")))


def kbp_short(n: Column) -> Column:
    """A distance in kbp: no decimals from 100, one from 10, else two, without zeros behind."""
    k = n / 1e3
    return F.when(k >= 100, F.call_function("format_number", k, F.lit("0"))).when(k >= 10, _trimmed(F.call_function("format_number", k, F.lit("0.0")))).otherwise(_trimmed(F.call_function("format_number", k, F.lit("0.00"))))


def variant_rate(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """``measured, included, rate``: calls that meet an arm's repeats, and how many of them reach into its variants.

    ``truth``: chrom, arm, start, end, variant_start, variant_end; ``calls``: chrom, label, start, end.  A b call is of
    both arms; the rate over nothing is 0."""
    met = overlap_join(truth, calls, "chrom").where((F.col("b_label") == F.col("arm")) | (F.col("b_label") == "b"))
    reach = (F.col("b_start") < F.col("variant_end")) & (F.col("variant_start") < F.col("b_end"))
    n, k = F.count("*"), F.coalesce(F.sum(reach.cast("long")), F.lit(0))
    return met.agg(n.alias("measured"), k.alias("included"), F.when(n > 0, k / n).otherwise(0.0).alias("rate"))
