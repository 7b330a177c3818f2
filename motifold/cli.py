"""``python -m motifold.cli scan|gfa|fastq|bam ...``: files in, files out."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import ScanConfig, prefix_list
from .operators import graph, matches, reads, select, simulate
from .operators.contigs import path_ends
from .plans.scan import Scan
from .sources import bam, fasta, fastq, files, gfa, tables


def options(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="motifold")
    p.add_argument("mode", choices=("scan", "gfa", "fastq", "bam", "simulate"))
    p.add_argument("input", help="a file; - for standard input; for simulate, how many sequences")
    p.add_argument("-o", "--output", default=".")
    for short, name, kind in (("-c", "canonical", str), ("-x", "edit-distance", int), ("-w", "window", int), ("-s", "step", int), ("-t", "terminal-limit", int), ("-k", "max-match-distance", int), ("-l", "min-block-length", int), ("-d", "max-block-distance", int), ("-y", "min-block-density", float)):
        p.add_argument(short, f"--{name}", type=kind)
    p.add_argument("-p", "--patterns", type=lambda x: tuple(x.split(",")))
    for short, name in (("-r", "repeats"), ("-g", "gc"), ("-e", "entropy"), ("-m", "matches"), ("-i", "its"), ("-n", "manual-curation")):
        p.add_argument(short, f"--{name}", action="store_true", default=None)
    p.add_argument("-v", "--version", action="version", version="motifold 0.2")
    p.add_argument("--cmd", action="store_true", help="print the command first")
    p.add_argument("--verbose", action="store_true", help="say on standard error what is being done")
    p.add_argument("-a", "--out-fasta", action="store_true", help="accepted; writes nothing")
    p.add_argument("-u", "--ultra-fast", action="store_true", help="tips only, which is what a scan without other outputs does")
    for name in ("include-file", "exclude-file"):
        p.add_argument(f"--{name}", action="append", default=[])
    for name in ("include-prefix", "exclude-prefix"):
        p.add_argument(f"--{name}", type=prefix_list, default=())
    return p.parse_args(argv)


def config(o: argparse.Namespace) -> ScanConfig:
    names = ("canonical", "edit_distance", "window", "step", "terminal_limit", "max_match_distance", "min_block_length", "max_block_distance", "min_block_density", "patterns", "repeats", "gc", "entropy", "matches", "its", "manual_curation")
    return ScanConfig(**{n: getattr(o, n) for n in names if getattr(o, n) is not None}, full=o.out_fasta and not o.ultra_fast, length_given=o.min_block_length is not None)


def _spooled(path: str, mode: str) -> str:
    """Standard input as a file called stdin; gzipped input only where it is BAM, which is."""
    if path != "-":
        return path
    to = os.path.join(tempfile.mkdtemp(prefix="motifold-"), "stdin")
    with open(to, "wb") as f:
        while chunk := sys.stdin.buffer.read(1 << 20):
            if f.tell() == 0 and chunk[:2] == b"\x1f\x8b" and mode != "bam":
                raise ValueError("gzipped standard input can't be read; unpack it or name a file")
            f.write(chunk)
    return to


def _write(lines, folder: str, name: str, header: str = "") -> None:
    with tempfile.TemporaryDirectory() as parts:
        files.write_ordered(lines, f"{parts}/x")
        files.one_file(f"{parts}/x", os.path.join(folder, name), header)


def chosen(spark: SparkSession, o: argparse.Namespace, records, name: str):
    if not (o.include_file or o.exclude_file or o.include_prefix or o.exclude_prefix):
        return records
    ids = lambda paths: tables.selectors(spark, paths) if paths else None
    include, exclude = ids(o.include_file), ids(o.exclude_file)
    for s in (include, exclude):
        if s is not None:
            select.checked(records, name, s)
    kept = select.select(records, name, include, o.include_prefix, exclude, o.exclude_prefix)
    if kept.head() is None:
        raise select.SelectionError("no record is left")
    return kept


def scan(spark: SparkSession, o: argparse.Namespace, c: ScanConfig) -> str:
    stem = os.path.join(os.path.basename(o.input))
    every = fasta.checked_fasta(spark, o.input)
    records = chosen(spark, o, every, "header")
    filtered = (every.count(), records.count()) if records is not every else None
    s = Scan(records, c)
    s.matches = s.matches.persist()  # for blocks, windows, files and sums; pieces that are lost are found again
    _write(tables.block_lines(s.terminal_blocks, c.manual_curation), o.output, f"{stem}_terminal_telomeres.bed")
    _write(tables.gap_lines(s.gaps), o.output, f"{stem}_gaps.bed")
    if c.its:
        _write(tables.interstitial_lines(s.interstitial_blocks), o.output, f"{stem}_interstitial_telomeres.bed")
    if c.matches:
        _write(tables.match_lines(s.matches.where("is_canonical")), o.output, f"{stem}_canonical_matches.bed")
        _write(tables.match_lines(matches.near_ends(s.matches, c.terminal_limit)), o.output, f"{stem}_noncanonical_matches.bed")
    tracks = [(x, x) for x, on in (("density", c.repeats), ("canonical_ratio", c.repeats), ("strand_ratio", c.repeats), ("gc", c.gc), ("entropy", c.entropy)) if on]
    for name, column in tracks:
        _write(tables.track_lines(s.windows, column), o.output, f"{stem}{tables.OUTPUTS[name]}", f'track type=bedGraph name="{name}"\n')
    names = ["pos", "header", "telomeres", "labels", "gaps", "type", "granular", *(("its", "canonical", "windows") if c.full else ())]
    report = os.path.join(o.output, f"{stem}_report.tsv")
    _write(tables.path_lines(s.path_summary), o.output, f"{stem}_report.tsv", "\n+++ Path Summary Report +++\n" + "\t".join(names) + "\n")
    with open(report, "a") as f:
        f.write(tables.summary_text(s.assembly_summary.first().asDict(), filtered))
    s.matches.unpersist()
    return report


def annotate(spark: SparkSession, o: argparse.Namespace, c: ScanConfig) -> str:
    lines = gfa.gfa_lines(spark, o.input)
    if o.include_file or o.exclude_file or o.include_prefix or o.exclude_prefix:
        lines = gfa.checked(lines)
    paths, segments = gfa.paths(lines), gfa.segments(lines)
    has_paths = paths.head() is not None
    if has_paths:
        kept = chosen(spark, o, paths.select("path_id").distinct(), "path_id")
        found = graph.caps(segments, c, path_ends(paths.join(kept, "path_id", "left_semi")))
    else:
        found = graph.caps(chosen(spark, o, segments, "segment"), c)
    stem = os.path.basename(o.input)
    _write(gfa.annotated(lines, graph.cap_lines(found)), o.output, f"{stem}.telo.annotated.gfa")
    _write(gfa.colors(found), o.output, f"{stem}.telo.annotated.gfa.colors.csv", "node\tcolor\n")
    return os.path.join(o.output, f"{stem}.telo.annotated.gfa")


def simulated(spark: SparkSession, o: argparse.Namespace, c: ScanConfig) -> None:
    """Sequences as wrapped FASTA, and a table of where their arms are."""
    made = simulate.chromosomes(spark, int(o.input), motif=c.canonical)
    _write(fasta.fasta_lines(made), o.output, "simulated.fa")
    truth = simulate.truth(made)
    columns = ["chrom", "arm", "start", "end"]
    lines = truth.select(F.struct("chrom", "arm").alias("seq_pos"), F.concat_ws("\t", *(F.col(x).cast("string") for x in columns)).alias("line"))
    _write(lines, o.output, "simulated_truth.tsv", "#" + "\t".join(columns) + "\n")


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    o = options(argv)
    say = (lambda x: print(x, file=sys.stderr)) if o.verbose else (lambda x: None)
    if o.cmd:
        print("motifold", *argv)
    if o.out_fasta:
        print("-a writes nothing; a scan with it isn't tips-only", file=sys.stderr)
    try:
        c = config(o)
        o.input = _spooled(o.input, o.mode)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("motifold").getOrCreate()
    say(f"{o.mode}: {o.input}, {len(c.expanded())} patterns")
    try:
        if o.mode == "scan":
            print(scan(spark, o, c))
        elif o.mode == "gfa":
            print(annotate(spark, o, c))
        elif o.mode == "simulate":
            simulated(spark, o, c)
        elif o.mode == "fastq":
            rows = fastq.fastq(spark, o.input)
            stem = os.path.basename(o.input).removesuffix(".gz").rsplit(".", 1)[0]
            _write(fastq.fastq_lines(reads.passing(rows, c)), o.output, f"{stem}_telomeric.fastq")
        else:
            rows = bam.bam(spark, o.input)
            stem = os.path.basename(o.input).rsplit(".", 1)[0]
            bam.write_bam(reads.passing(rows.where("has_seq"), c), bam.bam_header(o.input), os.path.join(o.output, f"{stem}_telomeric.bam"))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    say("done")
    return 0


if __name__ == "__main__":
    sys.exit(main())
