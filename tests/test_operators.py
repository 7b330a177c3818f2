"""Operators against brute force and pinned values."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifold.config import OptionError, ScanConfig, prefix_list
from motifold.functions import columns as X
from motifold.functions.patterns import expand, reverse_complement
from motifold.operators import blocks, intervals, islands, matches, reads, report, select, simulate, summary, windows
from motifold.plans.scan import Scan


def frame(spark, seqs):
    return spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "seq_pos long, header string, seq string")


def random_sequences(seed, n=12):
    rng = random.Random(seed)
    parts = ["CCCTAA", "TTAGGG", "CCCTAC", "CCCTCCCTAA", "N", "NNN", "ACGT", "GATTACA"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(n)] + ["", "CCC", None]


def test_patterns():
    assert [len(expand(("CCCTAA", "TTAGGG"), "CCCTAA", x)) for x in (0, 1, 2)] == [2, 38, 308]
    assert [(p.pattern, p.is_forward, p.is_canonical) for p in ScanConfig(edit_distance=0).expanded()] == [("CCCTAA", True, True), ("TTAGGG", False, True)]
    assert ScanConfig(canonical="ttaggg").canonical == "CCCTAA" and reverse_complement("CCCTAA") == "TTAGGG"
    assert {p.pattern for p in expand(("NCCTAA",), "CCCTAA", 0)} == {x for b in "ACGT" for x in (f"{b}CCTAA", reverse_complement(f"{b}CCTAA"))}
    assert expand(("CCCTA!",), "CCCTAA", 0) == []


@pytest.mark.parametrize("bad", [{"window": 0}, {"step": 2000}, {"edit_distance": 3}, {"min_block_density": 1.5}, {"canonical": "CC1"}, {"patterns": ("A1",)}, {"window": 100, "step": 98, "repeats": True}])
def test_options(bad):
    with pytest.raises(OptionError):
        ScanConfig(**bad)


def test_prefixes():
    assert prefix_list(" a, b") == ("a", "b")
    with pytest.raises(OptionError):
        prefix_list("a,")


@pytest.mark.parametrize("patterns", [(), ("CCCTAA", "CCCTAAA", "TTAGGGTTAGGGTTAGGG")])
def test_kernels_agree(spark, patterns):
    c = ScanConfig(patterns=patterns)
    contigs = Scan(frame(spark, random_sequences(1)), c).contigs.cache()
    want = Counter(map(tuple, matches.catalyst(contigs, c.expanded()).select("header", "abs_pos", "len", "is_forward", "is_canonical", "seq").collect()))
    assert want
    for tile in (1 << 16, 64, 19):
        got = matches.matches(contigs, c.expanded(), tile).select("header", "abs_pos", "len", "is_forward", "is_canonical", "seq").collect()
        assert Counter(map(tuple, got)) == want


def test_distances_of_all_places(spark):
    seqs = random_sequences(4)
    contigs = Scan(frame(spark, seqs), ScanConfig()).contigs.cache()
    want = Counter()
    for i, s in enumerate(seqs):
        for contig in (s or "").split("N"):
            for a in range(len(contig) - 5):
                want[i, min(sum(x != y for x, y in zip(contig[a : a + 6], m, strict=True)) for m in ("CCCTAA", "TTAGGG"))] += 1
    for tile in (1 << 16, 64, 19):
        assert Counter({tuple(r)[:2]: r["n"] for r in matches.distance_counts(contigs, ["CCCTAA", "TTAGGG"], tile).collect()}) == want


def test_partitioning_changes_nothing(spark):
    seqs = frame(spark, random_sequences(2, 30))
    c = ScanConfig(min_block_length=30, its=True, window=200, step=100)
    a, b = (Counter(map(tuple, Scan(s, c).path_summary.collect())) for s in (seqs.repartition(1), seqs.repartition(7)))
    assert a == b


def test_windows_hold_matches(spark):
    c = ScanConfig(edit_distance=0, window=100, step=50, repeats=True)
    seqs = [s for s in random_sequences(3) if s]
    s = Scan(frame(spark, seqs), c)
    hits = [(m["header"], m["contig_no"], m["pos"]) for m in s.matches.collect()]
    sizes = {(x["header"], x["contig_no"]): x["contig_len"] for x in s.contigs.collect()}
    start = {(x["header"], x["contig_no"]): x["contig_start"] for x in s.contigs.collect()}
    want = Counter()
    for h, n, pos in hits:
        for k in range((sizes[h, n] - 1) // 50 + 1):
            if k * 50 <= pos and pos + 6 <= min(k * 50 + 100, sizes[h, n]):
                want[h, start[h, n] + k * 50] += 6
    got = {(w["header"], w["start"]): w["forward_covered"] + w["reverse_covered"] for w in windows.covered_windows(s.contigs, s.matches, 100, 50).collect()}
    assert {k: v for k, v in got.items() if v} == dict(want)


def test_wrapped_gap_and_n50(spark):
    s = Scan(frame(spark, ["CCCTAANNNNNNTTAGGG"]), ScanConfig())
    assert [tuple(r)[2:] for r in s.gaps.collect()] == [(6, 12)]
    r = s.assembly_summary.first()
    assert (r["scaffold_n50"], r["contig_n50"], r["gaps"]) == (18, 6, 1)
    r = Scan(frame(spark, ["A" * 1000 + "N" * 50 + "A" * 600, "A" * 800]), ScanConfig()).assembly_summary.first()
    assert (r["scaffold_n50"], r["contig_n50"]) == (1650, 800)
    assert summary.n50(spark.createDataFrame([], "length long")).first()["n50"] is None


def test_reads(spark):
    def kept(seqs, **options):
        rows = spark.createDataFrame(list(enumerate(seqs)), "idx long, seq string")
        return sorted(r["idx"] for r in reads.passing(rows, ScanConfig(**options)).collect())

    assert kept(["TTAGGG" * 6, "TTAGGG" * 7, "ccctaa" * 7 + "\r", "", None, "N" * 50]) == [1, 2]
    row = ["TTAGGGAAAAAATTAGGG"]
    base = {"edit_distance": 0, "max_match_distance": 20, "min_block_length": 18}
    assert kept(row, **base, min_block_density=0.666) == [0] and kept(row, **base, min_block_density=0.667) == []
    rows = spark.createDataFrame([(0, "TTAGGG" * 9), (1, None), (2, "*")], "idx long, seq string")
    assert tuple(reads.counts(rows, ScanConfig()).first()) == (3, 1, 2)


def test_passing_is_one_pass_and_agrees_with_blocks(spark):
    seqs = random_sequences(7, 60) + ["é" + "CCCTAA" * 9, "CCCTAA" * 9 + "A" * 60 + "é" * 50 + "CCCTAA" * 9]
    contig = spark.createDataFrame([(i, "", len(s or ""), 0, 0, len(s or ""), s or "") for i, s in enumerate(seqs)], "seq_pos long, header string, path_size long, contig_no int, contig_start long, contig_len long, bases string")
    rows = contig.select(F.col("seq_pos").alias("idx"), F.col("bases").alias("seq"))
    seen = set()
    for options in ({}, {"edit_distance": 0}, {"edit_distance": 0, "min_block_length": 150, "max_block_distance": 20}, {"patterns": ("CCCTAA", "CCCTAAA", "TTAGGGTTAGGGTTAGGG"), "max_match_distance": 7, "min_block_length": 60}, {"min_block_density": 0.9, "min_matches": 5}):
        c = ScanConfig(**options)
        want = {r[0] for r in blocks.terminal_blocks(matches.matches(contig, c.for_reads().expanded()), c.for_reads()).select("seq_pos").collect()}
        got = reads.passing(rows, c)
        assert sorted(r["idx"] for r in got.collect()) == sorted(want)
        seen.add(len(want))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan
    assert len(seen) > 2


def test_kernel_looks_at_spans(monkeypatch):
    """Matches of many spans are those of one, and memory follows the span, not the batch."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTN") if rng.random() < 0.3 else rng.choice(["CCCTAA", "TTAGGG"]) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    kernel = matches.Kernel(ScanConfig(patterns=("CCCTAA", "CCCTAACCCTAA", "TTAGGG" * 6), edit_distance=0).expanded())
    data, off = matches.ascii_texts(pa.array(texts))
    whole = [x.tolist() for x in kernel.find(data, off)]
    assert whole[0] == sorted(whole[0]) and len(set(kernel.length[whole[2]])) == 3
    for span in (1, 7, 64, 1000):
        monkeypatch.setattr(matches, "SPAN", span)
        assert [x.tolist() for x in kernel.find(data, off)] == whole
    monkeypatch.undo()
    data = np.frombuffer(b"CATTGA" * (1 << 20), np.uint8)
    tracemalloc.start()
    kernel.find(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(data)  # 40 times and more when all codes are made at once


def test_selection(spark):
    records = spark.createDataFrame([(x,) for x in ("chr1", "chr10", "chr2", "scaf_1", "a%b", "axb")], "header string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(select.select(records, includes=ids("chr2", "chr2"), include_prefixes=("scaf",))) == ["chr2", "scaf_1"]
    assert names(select.select(records, include_prefixes=("chr",), exclude_prefixes=("chr1",))) == ["chr2"]
    assert names(select.select(records, include_prefixes=("a%",))) == ["a%b"]
    assert names(select.select(records, excludes=ids("chr1", "nope"))) == ["a%b", "axb", "chr10", "chr2", "scaf_1"]
    assert names(select.unmatched_ids(ids("chr1", "x"), records)) == ["x"]
    assert names(select.unmatched_prefixes(spark.createDataFrame([("chr",), ("zz",)], "prefix string"), records)) == ["zz"]
    with pytest.raises(select.SelectionError, match="and 2 more"):
        select.checked(records, selectors=ids(*(f"x{i:02}" for i in range(12))))
    with pytest.raises(select.SelectionError, match="duplicate"):
        select.checked(records.union(records.limit(1)))


def test_prefixes_of_many_lengths(spark):
    records = spark.createDataFrame([("a" * 1100,), ("b",), (None,)], "header string")
    prefixes = spark.createDataFrame([("a" * n,) for n in range(1, 1102)] + [("c" * 1050,)], "prefix string")
    assert sorted(r[0] for r in select.unmatched_prefixes(prefixes, records).collect()) == ["a" * 1101, "c" * 1050]


def test_overlaps(spark):
    rng = random.Random(6)
    draw = lambda n: [(rng.choice("ab"), s := rng.randint(0, 3000), s + rng.randint(0, 900)) for _ in range(n)]
    a, b = draw(60), draw(50)
    fa, fb = (spark.createDataFrame(x, "chrom string, start long, end long") for x in (a, b))
    want = Counter((*x, y[1], y[2]) for x in a for y in b if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    assert Counter(map(tuple, intervals.overlap_join(fa, fb, "chrom", 128).select("chrom", "start", "end", "b_start", "b_end").collect())) == want
    hit = {k[:3] for k in want}
    assert Counter(map(tuple, intervals.not_overlapping(fa, fb, "chrom").collect())) == Counter(x for x in a if x not in hit)
    assert [tuple(r) for r in intervals.clipped(spark.createDataFrame([("a", 0, 10), ("a", 20, 40), ("a", 50, 60)], "chrom string, start long, end long"), 5, 30).collect()] == [("a", 5, 10), ("a", 20, 30)]


def test_report_tables(spark):
    blocks = spark.createDataFrame([("c", "p", 0, 6600, 6600, 20000), ("c", "q", 13400, 20000, 6600, 20000)], "chrom string, label string, start long, end long, length long, path_size long")
    assert tuple(report.view_windows(blocks).first()) == ("c", 0, 14000, 6000, 20000)
    values = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    assert [r["v"] for r in report.outliers(values, "v").where("outlier").collect()] == [100.0]
    assert report.outliers(values.limit(3), "v").where("outlier").count() == 0
    its = spark.createDataFrame([("c", 0, 10), ("c", 5, 100), ("c", 300, 350), ("c", 340, 360)], "chrom string, start long, end long")
    assert [tuple(r)[2:] for r in islands.clusters(its, ["chrom"], "start", "end", 50).orderBy("start").collect()] == [(0, 100, 105, 2), (300, 360, 70, 2)]
    assert tuple(report.best_cluster(its, 50).first()) == ("c", 0, 100, 105, 2)


def test_simulation(spark):
    s = simulate.chromosomes(spark, 3, repeats=100, variants=5, inner=500)
    rows = s.collect()
    assert [len(r["seq"]) for r in rows] == [2 * 105 * 6 + 500] * 3 and all(r["seq"].startswith("CCCTAA" * 100) and r["seq"].endswith("TTAGGG" * 100) for r in rows)
    assert rows == simulate.chromosomes(spark, 3, repeats=100, variants=5, inner=500).collect()
    calls = Scan(s.select("seq_pos", "header", "seq"), ScanConfig()).terminal_blocks.selectExpr("header chrom", "label", "start", "end")
    e = intervals.evaluation(simulate.truth(s), calls).first()
    assert e["sensitivity"] == 1.0 and e["false_positives"] == 0


def test_scalars(spark):
    assert X.general(0.1 + 0.2) == "0.3" and X.general(600.0) == "600" and X.region("chr1:1,000-2kb") == ("chr1", 1000, 2000)
    r = spark.range(1).select(X.strict_unsigned(X.F.lit("18446744073709551615")), X.strict_unsigned(X.F.lit("18446744073709551616")), X.strict_unsigned(X.F.lit("-1")), X.strict_unsigned(X.F.lit("1x"))).first()
    assert [x is not None for x in r] == [True, False, False, False]
