"""Interval files and report tables."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import general, strict_unsigned
from .files import expand, unsigned


def _fields(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "^﻿|\r$", "").alias("line"))
    kept = raw.where("trim(line) <> '' and not line rlike '^(#|track|browser)'")
    return kept.withColumn("f", F.split("line", "\t", -1))


def selectors(spark: SparkSession, path: str) -> DataFrame:
    """``id``: one a line, or the names of BED lines, whose coordinates must be numbers in order."""
    f = _fields(spark, path)
    a, b = strict_unsigned(F.get("f", F.lit(1))), strict_unsigned(F.get("f", F.lit(2)))
    bad = f.where((F.size("f") == 2) | (F.size("f") >= 3) & ~F.coalesce(a <= b, F.lit(False))).select("line").head()
    if bad:
        raise ValueError(f"neither an id nor an interval: {bad[0]!r}")
    return f.select(F.trim(F.get("f", F.lit(0))).alias("id")).distinct()


BLOCK_FIELDS = ("chrom", "start", "end", "length", "label", "forward_count", "reverse_count", "canonical_count", "noncanonical_count", "path_size", "terminality")


def block_bed(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of ten columns or eleven; lines whose numbers aren't numbers go."""
    f = _fields(spark, path).where(F.size("f") >= 10)
    text = ("chrom", "label", "terminality")
    c = {n: F.get("f", F.lit(i)) if n in text else unsigned(F.get("f", F.lit(i))) for i, n in enumerate(BLOCK_FIELDS)}
    return f.select(*(x.alias(n) for n, x in c.items())).where(" and ".join(f"{n} is not null" for n in BLOCK_FIELDS if n not in text))


def bed(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(spark, path)
    return f.select(F.get("f", F.lit(0)).alias("chrom"), unsigned(F.get("f", F.lit(1))).alias("start"), unsigned(F.get("f", F.lit(2))).alias("end")).where("start is not null and end is not null and end > start")


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Intervals with finite values."""
    f = _fields(spark, path)
    value = F.get("f", F.lit(3)).try_cast("double")
    out = f.select(F.get("f", F.lit(0)).alias("chrom"), unsigned(F.get("f", F.lit(1))).alias("start"), unsigned(F.get("f", F.lit(2))).alias("end"), value.alias("value"))
    return out.where("end > start and value is not null and not isnan(value) and abs(value) < double('Infinity')")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, arm, start, end``: both arms of each line of a truth table."""
    f = _fields(spark, path)
    at = lambda i: unsigned(F.get("f", F.lit(i)))
    arms = F.array(*(F.struct(F.lit(a).alias("arm"), at(s).alias("start"), at(e).alias("end")) for a, s, e in (("p", 2, 3), ("q", 8, 9))))
    return f.select(F.get("f", F.lit(0)).alias("chrom"), F.explode(arms).alias("x")).select("chrom", "x.*").where("start is not null and end is not null")


# Names that reports have had for classes.
TYPE_NAMES = {"missassembly": "misassembly", "gapped_missassembly": "gapped_misassembly"}


def report(spark: SparkSession, path: str) -> DataFrame:
    """Path rows of a report: between the line of column names and the next blank or section line."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("line"))
    head = lines.where("startswith(line, 'pos\theader\t')").orderBy("n").head()
    if not head:
        return spark.createDataFrame([], "pos long, header string, type string")
    names = head["line"].split("\t")
    end = lines.where((F.col("n") > head["n"]) & ((F.trim("line") == "") | F.col("line").startswith("+++"))).agg(F.min("n")).first()[0]
    body = lines.where((F.col("n") > head["n"]) & (F.col("n") < (end if end is not None else 1 << 62))).withColumn("f", F.split("line", "\t", -1))
    known = F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv))
    out = body.select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return out.withColumn("type", F.coalesce(known[F.col("type")], F.col("type"))).withColumn("pos", F.col("pos").cast("long"))


# How the names of a scan's files end.
OUTPUTS = {
    "terminal": "_terminal_telomeres.bed",
    "interstitial": "_interstitial_telomeres.bed",
    "gaps": "_gaps.bed",
    "density": "_window_repeat_density.bedgraph",
    "canonical_ratio": "_window_canonical_ratio.bedgraph",
    "strand_ratio": "_window_strand_ratio.bedgraph",
    "gc": "_window_gc.bedgraph",
    "entropy": "_window_entropy.bedgraph",
    "report": "_report.tsv",
}


def discovered(folder: str) -> dict[str, str]:
    """Which of a scan's files a folder has; of several the first by name, with a warning."""
    names, found = expand(folder), {}
    for key, suffix in OUTPUTS.items():
        hits = [x for x in names if x.endswith(suffix)]
        if len(hits) > 1:
            warnings.warn(f"several files end in {suffix}: {hits[0]} is read", stacklevel=2)
        if hits:
            found[key] = hits[0]
    return found


# what a scan writes: ``seq_pos, line`` ------------------------------------------------------------------------------


def _lines(df: DataFrame, order: list[str], *columns) -> DataFrame:
    key = F.struct(*order)
    return df.select(key.alias("seq_pos"), F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns)).alias("line"))


def block_lines(blocks: DataFrame, manual: bool = False) -> DataFrame:
    b = blocks if manual else blocks.where("scaffold_terminal")
    return _lines(b, ["seq_pos", "start"], "header", "start", "end", "length", "label", *BLOCK_FIELDS[5:10], F.when(F.col("scaffold_terminal"), "scaffold").otherwise("contig"))


def interstitial_lines(blocks: DataFrame) -> DataFrame:
    return _lines(blocks, ["seq_pos", "start"], "header", "start", "end", "length", "label", *BLOCK_FIELDS[5:10])


def gap_lines(gaps: DataFrame) -> DataFrame:
    return _lines(gaps, ["seq_pos", "start"], "header", "start", "end")


def match_lines(found: DataFrame) -> DataFrame:
    return _lines(found, ["seq_pos", "abs_pos", "len"], "header", "abs_pos", F.col("abs_pos") + F.col("len"), "seq")


def track_lines(windows: DataFrame, value: str) -> DataFrame:
    """Values in single precision with six digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x is None else general(x) for x in batch.column(batch.num_columns - 1).to_pylist()]  # C's %g, which Java's differs from
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string())], names=[*batch.schema.names[:-1], "digits"])

    w = windows.select("seq_pos", "header", "start", "end", F.col(value).cast("float").alias("value"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in w.schema if f.name != "value")
    return _lines(w.mapInArrow(run, f"{fields}, digits string"), ["seq_pos", "start"], "header", "start", "end", "digits")


def path_lines(summary: DataFrame) -> DataFrame:
    names = ["header", "telomeres", "labels", "gaps", "type", "granular", *(c for c in ("its", "canonical", "windows") if c in summary.columns)]
    return _lines(summary, ["seq_pos"], F.col("seq_pos") + 1, *names)


# Sections and labels of the summary.
def summary_text(row: dict, filtered: tuple[int, int] | None = None) -> str:
    """The assembly summary as text."""
    full = "its" in row
    out = ["", "+++ Assembly Summary Report +++", f"Total paths:\t{row['paths']}"]
    if filtered:
        out += [f"Filter input paths:\t{filtered[0]}", f"Filter selected paths:\t{filtered[1]}"]
    out += [f"Total gaps:\t{row['gaps']}", f"Scaffold N50:\t{row['scaffold_n50']}", f"Contig N50:\t{row['contig_n50']}", f"Total telomeres:\t{row['telomeres']}"]
    if full:
        out += [f"Total ITS blocks:\t{row['its']}", f"Total canonical matches:\t{row['canonical_matches']}", f"Total windows analyzed:\t{row['windows']}"]
    out += ["", "+++ Telomere Statistics +++"]
    out += [f"{n} length:\t{general(row[k])}" for n, k in (("Mean", "mean"), ("Median", "median"), ("Min", "min"), ("Max", "max"))] if row["telomeres"] else ["No telomeres found for statistics."]
    both = lambda c: row[c] + row[f"gapped_{c}"]
    out += ["", "+++ Chromosome Telomere Counts+++", f"Two telomeres:\t{both('t2t') + both('misassembly')}", f"One telomere:\t{both('incomplete')}", f"Zero telomeres:\t{both('none')}", "", "+++ Chromosome Telomere/Gap Completeness+++"]
    for name, c in (("T2T", "t2t"), ("Misassembled", "misassembly"), ("Incomplete", "incomplete"), ("No telomeres", "none"), ("Discordant", "discordant")):
        out += [f"{name}:\t{row[c]}", f"Gapped {name if name == 'T2T' else name.lower()}:\t{row[f'gapped_{c}']}"]
    return "\n".join(out) + "\n"
