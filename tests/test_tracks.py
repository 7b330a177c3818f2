"""Views, axes and series of figures; pieces of contigs; record numbers; the command line's files."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from motifold import cli
from motifold.config import ScanConfig
from motifold.functions.patterns import Pattern
from motifold.operators import blocks, matches, report, summary, tracks, windows
from motifold.sources import fasta, files, gfa, tables


def block(chrom, label, start, end, size=100_000):
    return (chrom, label, start, end, end - start, size)


BLOCKS = "chrom string, label string, start long, end long, length long, path_size long"


@pytest.fixture(scope="module")
def shown(spark):
    rows = [block("one", "p", 0, 10_000), block("both", "p", 0, 2_000), block("both", "q", 97_000, 100_000), block("far", "p", 0, 1_000), block("far", "q", 60_000, 99_000), block("b", "b", 40_000, 41_000), block("none", "x", 5, 9), block("small", "q", 100, 300, 700)]
    return spark.createDataFrame(rows, BLOCKS)


def test_view_windows(shown):
    got = {r["chrom"]: tuple(r)[1:] for r in report.view_windows(shown).collect()}
    assert got == {
        "one": (0, 20_000, 80_000, 100_000),  # the arm without blocks takes the other's
        "both": (0, 6_000, 94_000, 100_000),
        "far": (0, 2_000, 20_000, 100_000),  # too different to share
        "b": (0, 100_000, 0, 100_000),
        "small": (0, 700, 0, 700),
    }
    merged = {r["chrom"]: r["merged"] for r in tracks.merged_panels(shown, report.view_windows(shown)).collect()}
    assert merged == {"one": False, "both": False, "far": False, "b": True, "none": True, "small": False}


def test_tracks(spark, shown):
    near, far = tracks.terminal_interval(F.col("label"), F.col("start"), F.col("end"), F.col("path_size"))
    got = {(r[0], r[1]): (r[2], r[3]) for r in shown.select("chrom", "label", near, far).collect()}
    assert got["far", "q"] == (1_000, 40_000) and got["far", "p"] == (0, 1_000) and got["b", "b"] == (40_000, 41_000)
    series = spark.createDataFrame([("a", 0, 10, 0.5), ("a", 10, 20, -1.0), ("b", 5, 9, 2.0)], "chrom string, start long, end long, value double")
    assert sorted(map(tuple, tracks.step_points(series, ["chrom"]).collect())) == [("a", 0, 0.5), ("a", 10, 0.0), ("a", 20, -1.0), ("b", 5, 2.0), ("b", 9, 2.0)]
    mirrored = tracks.projected(series.where("chrom = 'a'"), F.lit("q"), F.lit(20))
    assert sorted((r["start"], r["end"]) for r in mirrored.collect()) == [(0, 10), (10, 20)]
    values = spark.createDataFrame([(float("nan"),), (float("inf"),), (-1.0,), (0.0,), (None,), (9.0,)], "v double")
    assert [r[0] for r in values.select(tracks.valid_value(F.col("v"))).collect()] == [False, False, False, True, False, True]
    one = spark.range(1)
    ticks = lambda a, b, arm: [x["text"] for x in one.select(tracks.axis_ticks(F.lit(a), F.lit(b), F.lit(arm))).first()[0]]
    assert ticks(0, 10_000, "p") == ["0", "2.5", "5", "7.5", "10"] and ticks(0, 4_000_000, "") == ["0.0", "1.0", "2.0", "3.0", "4.0"]
    assert ticks(0, 400, "") == ["0", "100", "200", "300", "400"] and ticks(1_000, 9_000, "") == ["1", "3", "5", "7", "9"]
    assert one.select(tracks.axis_ticks(F.lit(5), F.lit(5), F.lit("p"))).first()[0] is None
    text = spark.createDataFrame([(999,), (1_500,), (12_340,), (123_456,), (2_500_000,)], "n long")
    assert [tuple(r) for r in text.select(tracks.bp_short(F.col("n")), tracks.kbp_short(F.col("n"))).collect()] == [("999 bp", "1"), ("1.5 kb", "1.5"), ("12.3 kb", "12.3"), ("123.5 kb", "123"), ("2.50 Mb", "2500")]
    fits = shown.select("chrom", tracks.glyph_fits(F.col("label"), F.col("length"), F.col("path_size")))
    assert dict(map(tuple, fits.where("chrom in ('one', 'b', 'none')").collect())) == {"one": True, "b": False, "none": False}
    assert {tuple(r) for r in tracks.labels_in_view(shown, F.lit(50_000), F.lit(98_000)).collect()} == {("both", "q"), ("far", "q")}
    sizes = spark.createDataFrame([("a", 5), ("b", 9), ("c", 0)], "chrom string, size long")
    assert [r[0] for r in tracks.by_size(sizes).collect()] == ["b", "a"]
    assert {r[0] for r in tracks.without_size(spark.createDataFrame([("a",), ("c",), ("d",)], "chrom string"), sizes).collect()} == {"c", "d"}


def test_variant_rate(spark):
    truth = spark.createDataFrame([("c", "p", 0, 100, 100, 150), ("c", "q", 900, 1000, 850, 900)], "chrom string, arm string, start long, end long, variant_start long, variant_end long")
    calls = spark.createDataFrame([("c", "p", 0, 120), ("c", "q", 905, 1000), ("c", "b", 890, 950), ("c", "p", 500, 600)], "chrom string, label string, start long, end long")
    assert tuple(tracks.variant_rate(truth, calls).first()) == (3, 2, 2 / 3)
    assert tuple(tracks.variant_rate(truth, calls.limit(0)).first()) == (0, 0, 0.0)


def contig(spark, seq):
    return spark.createDataFrame([(0, "c", len(seq), 0, 0, len(seq), seq)], "seq_pos long, header string, path_size long, contig_no int, contig_start long, contig_len long, bases string")


def test_long_patterns_and_odd_letters(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("ACGT") for _ in range(45))
    other = long[:31] + "".join(rng.choice("ACGT") for _ in range(9))
    seq = "é" + long + "N" + other + long[:-1] + "T" * 7 + long
    found = matches.matches(contig(spark, seq), [Pattern(long, True, True, 45), Pattern(other, False, False, 40), Pattern("TTTTTTT", True, False, 7)], 16).collect()
    want = [(i, p) for p in (long, other, "TTTTTTT") for i in range(len(seq)) if seq.startswith(p, i)]
    assert sorted((r["pos"], r["seq"]) for r in found) == sorted(want) and {r["is_forward"] for r in found if r["seq"] == other} == {False}


def test_runs_across_stretches(spark):
    """Runs folded in stretches of any length are those of a whole contig."""
    rng = random.Random(7)
    at, rows = 0, []
    for _ in range(600):
        at += rng.choice([1, 3, 6, 6, 40, 50, 51, 90])
        rows.append((0, "c", 90_000, 0, 0, 90_000, at, rng.choice([5, 6, 7]), rng.random() < 0.5, rng.random() < 0.5))
    rows += [(*r[:7], r[7] + 3, *r[8:]) for r in rows[::50]]
    found = spark.createDataFrame(rows, "seq_pos long, header string, path_size long, contig_no int, contig_start long, contig_len long, pos long, len int, is_forward boolean, is_canonical boolean")
    c = ScanConfig(max_match_distance=50)
    want = sorted(map(tuple, blocks.runs(found, [*blocks.CONTIG, "is_forward"], c, 1 << 20).drop("island").collect()))
    for stretch in (1, 37, 1000):
        assert sorted(map(tuple, blocks.runs(found, [*blocks.CONTIG, "is_forward"], c, stretch).drop("island").collect())) == want


def test_windows_take_time_in_proportion(spark):
    def seconds(n):
        frame = contig(spark, "ACGTTTAGGG" * (n // 10))
        at = time.time()
        assert windows.windows(frame, 1000, 1000).agg(F.sum("size")).first()[0] == n
        return time.time() - at

    seconds(1_000_000)
    assert seconds(16_000_000) < 12 * max(1.0, seconds(2_000_000))
    cut = windows.windows(contig(spark, "ACGTACGTAC"), 4, 3).orderBy("window_no").select("start", "end", "n_a").collect()
    assert [tuple(r) for r in cut] == [(0, 4, 1), (3, 7, 1), (6, 10, 1), (9, 10, 0)]


def test_stats_of_nothing_and_ties(spark):
    lengths = spark.createDataFrame([(5,), (5,), (9,), (None,)], "length long")
    r = summary.length_stats(lengths).first()
    assert (r["n"], r["median"], r["min"], r["max"]) == (4, 5.0, 5, 9) and abs(r["mean"] - 19 / 3) < 1e-9
    assert summary.length_stats(lengths.limit(0)).first()["n"] == 0
    marked = report.outliers(spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 100]], "v double"), "v").collect()
    assert {r["v"] for r in marked if r["outlier"]} == {100.0}


def test_record_numbers(spark, tmp_path):
    (tmp_path / "x.fa").write_text("".join(f">r{i} c\nACGT{'A' * (i % 9)}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = fasta.fasta(spark, f"{tmp_path}/x.fa")
        assert got.rdd.getNumPartitions() > 2
        assert sorted((r["seq_pos"], r["header"]) for r in got.collect()) == [(i, f"r{i}") for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    big = str((1 << 64) - 1)
    text = spark.createDataFrame([(big,), (str(1 << 64),), (str((1 << 63) - 1),), ("007",), ("-1",), ("",)], "x string")
    assert [r[0] for r in text.select(files.unsigned(F.col("x"))).collect()] == [None, None, (1 << 63) - 1, 7, None, None]
    (tmp_path / "ids.bed").write_text(f"chr1\t0\t{big}\n")
    assert [r[0] for r in tables.selectors(spark, f"{tmp_path}/ids.bed").collect()] == ["chr1"]


def test_second_version_of_graphs(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("H\tVN:Z:2.0\nS\ta\t4\tACGT\tLN:i:4\nS\tb\t*\n")
    lines = gfa.gfa_lines(spark, f"{tmp_path}/g.gfa")
    out = gfa.annotated(lines, spark.createDataFrame([], "rank int, node string, line string"))
    assert {r["line"] for r in out.collect()} == {"H\tVN:Z:1.2", "S\ta\tACGT\tLN:i:4", "S\tb\t*"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    repeat = "CCCTAA" * 100 + "ACGT" * 300 + "TTAGGG" * 100
    (tmp_path / "a.fa").write_text(f">x\n{repeat}\n>y\nACGTACGT\n")
    assert cli.main(["scan", f"{tmp_path}/a.fa", "-o", str(tmp_path), "-r", "--include-prefix", "x", "--verbose", "--cmd", "-a"]) == 0
    said = capsys.readouterr()
    assert "motifold scan" in said.out and "patterns" in said.err and "writes nothing" in said.err
    report_text = (tmp_path / "a.fa_report.tsv").read_text()
    assert "Filter input paths:\t2" in report_text and "Filter selected paths:\t1" in report_text
    assert set(tables.discovered(str(tmp_path))) >= {"terminal", "gaps", "report", "density", "strand_ratio"}
    (tmp_path / "g.gfa").write_text("S\ta\tACGT\nW\tx\ty\n")
    assert cli.main(["gfa", f"{tmp_path}/g.gfa", "-o", str(tmp_path), "--include-prefix", "a"]) == 1 and "line 2: unknown record" in capsys.readouterr().err
    assert cli.main(["simulate", "2", "-o", str(tmp_path)]) == 0
    assert (tmp_path / "simulated.fa").read_text().count(">") == 2 and (tmp_path / "simulated_truth.tsv").read_text().count("\n") == 5
    c = cli.config(cli.options(["fastq", "x", "-l", "300"]))
    assert c.for_reads().min_block_length == 300 and ScanConfig().for_reads().min_block_length == 42


def test_stream_counts(spark, tmp_path):
    from motifold.streaming.reads import filter_stream

    rows = [(0, "CCCTAA" * 20), (1, "ACGT" * 20), (2, None), (3, "*")]
    spark.createDataFrame(rows, "idx long, seq string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("idx long, seq string").parquet(f"{tmp_path}/in")
    q = filter_stream(stream, ScanConfig(edit_distance=0), lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    q.awaitTermination()
    assert [r["idx"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [0]
    seen = [p.observedMetrics["reads"] for p in q.recentProgress if "reads" in p.observedMetrics]
    assert sum(x["total"] for x in seen) == 4 and sum(x["missing"] for x in seen) == 2


def test_table_function(spark):
    from motifold.functions.tables import register

    register(spark, ScanConfig(edit_distance=0))
    got = spark.sql("SELECT id, m.* FROM VALUES (1, 'ccctaaNTTAGGGA'), (2, NULL), (3, '') AS t(id, seq), LATERAL scan_motifs(seq) AS m").collect()
    assert [tuple(r) for r in got] == [(1, 0, 6, True, True, "CCCTAA"), (1, 7, 6, False, True, "TTAGGG")]
