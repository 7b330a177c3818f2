"""Each sequence's class, from its terminal blocks and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PATH = ["seq_pos", "header"]
CLASSES = ("t2t", "misassembly", "incomplete", "none", "discordant")


def with_longest(blocks: DataFrame) -> DataFrame:
    """Adds ``is_longest``: of each label, the scaffold-terminal block that covers most canonically, the first on ties."""
    w = Window.partitionBy(*PATH, "label", "scaffold_terminal").orderBy(F.desc("canonical_covered"), "start")
    return blocks.withColumn("is_longest", (F.row_number().over(w) == 1) & F.col("scaffold_terminal") & (F.col("canonical_covered") > 0))


def path_summary(sequences: DataFrame, gaps: DataFrame, blocks: DataFrame) -> DataFrame:
    """``seq_pos, header, path_size, telomeres, labels, gaps, type, granular`` of every sequence.

    ``blocks`` needs ``scaffold_terminal``.  Labels are those of the longest blocks in order; ``granular`` has all
    blocks, starred where the orientation is not valid, upper case for the longest."""
    b = with_longest(blocks)
    mark = F.concat(F.when(F.col("is_longest"), F.upper("label")).otherwise(F.col("label")), F.when(F.col("valid_orientation"), "").otherwise("*"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["m"]), "")
    of = lambda label, cond: F.col("is_longest") & (F.col("label") == label) & cond
    yes = F.lit(True)
    per_path = b.groupBy(*PATH).agg(
        text(F.struct("start", "label", mark.alias("m"))).alias("granular"),
        text(F.when(F.col("is_longest"), F.struct("start", "label", F.col("label").alias("m")))).alias("labels"),
        F.sum(F.col("is_longest").cast("long")).alias("telomeres"),
        F.max(F.col("is_longest") & ~F.col("valid_orientation")).alias("wrong"),
        F.min(F.when(of("p", yes), F.col("start"))).alias("p_start"),
        F.min(F.when(of("q", yes), F.col("start"))).alias("q_start"),
        *(F.max(F.col("scaffold_terminal") & ~F.col("is_longest") & F.col("valid_orientation") & (F.col("label") == x)).alias(f"more_{x}") for x in "pq"),
    )
    n_gaps = gaps.groupBy(*PATH).agg(F.count("*").alias("gaps"))
    all_paths = sequences.select(*PATH, F.length(F.coalesce("seq", F.lit(""))).cast("long").alias("path_size"))
    s = all_paths.join(per_path, PATH, "left").join(n_gaps, PATH, "left")
    p, q = F.col("p_start").isNotNull(), F.col("q_start").isNotNull()
    plain = (
        F.when(F.col("wrong"), "discordant")
        .when(p & q, F.when(F.col("p_start") < F.col("q_start"), "t2t").otherwise("misassembly"))
        .when((p & F.col("more_p")) | (q & F.col("more_q")), "misassembly")
        .when(~p & ~q, "none")
        .otherwise("incomplete")
    )
    return s.select(
        *PATH, "path_size", F.coalesce("telomeres", F.lit(0)).alias("telomeres"), F.when(F.coalesce("labels", F.lit("")) == "", "none").otherwise(F.col("labels")).alias("labels"),
        F.coalesce("gaps", F.lit(0)).alias("gaps"), F.concat(F.when(F.col("gaps") > 0, "gapped_").otherwise(""), plain).alias("type"), F.coalesce("granular", F.lit("")).alias("granular"),
    )


def full_columns(summary: DataFrame, its: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``its, canonical, windows``: counts of a full scan."""
    count = lambda df, name: df.groupBy(*PATH).agg(F.count("*").alias(name))
    out = summary.join(count(its, "its"), PATH, "left").join(count(found.where("is_canonical"), "canonical"), PATH, "left").join(count(windows, "windows"), PATH, "left")
    return out.fillna(0, ["its", "canonical", "windows"])
