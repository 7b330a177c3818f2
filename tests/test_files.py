"""Files: reading, writing, round trips, broken input."""

from __future__ import annotations

import gzip
import random
import struct

import pytest

from motifold import cli
from motifold.config import ScanConfig
from motifold.operators import graph
from motifold.operators.contigs import path_ends
from motifold.sources import bam, bgzf, fasta, fastq, files, gfa, tables

READS = [("@r0 x", "TTAGGG" * 9), ("@r1", "ACGT" * 20), ("@r2", "ccctaa" * 9), ("@r3", "A")]


def fastq_text(eol="\n"):
    return "".join(eol.join((h, s, "+", "I" * len(s))) + eol for h, s in READS)


def test_fasta(spark, tmp_path):
    text = "﻿>a first one\r\nACGT\r\nNN\r\n>b\r\nTTAGGG"
    (tmp_path / "x.fa").write_text(text)
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(text)
    for name in ("x.fa", "y.fa.gz"):
        rows = fasta.checked_fasta(spark, str(tmp_path / name)).orderBy("seq_pos").collect()
        assert [(r["header"], r["comment"], r["seq"]) for r in rows] == [("a", "first one", "ACGTNN"), ("b", "", "TTAGGG")]
    for bad in (">a\nAC\n>a\nGT\n", ">a\n>b\nAC\n", "> x\nAC\n"):
        (tmp_path / "bad.fa").write_text(bad)
        with pytest.raises(fasta.FormatError):
            fasta.checked_fasta(spark, str(tmp_path / "bad.fa"))


def test_fastq(spark, tmp_path):
    for name, text in (("a.fq", fastq_text()), ("b.fq", "\n\n" + fastq_text("\r\n").replace("@r2", "\r\n@r2"))):
        (tmp_path / name).write_text(text, newline="")
        rows = fastq.fastq(spark, str(tmp_path / name)).orderBy("idx").collect()
        assert [(r["header"].strip(), r["seq"].strip()) for r in rows] == READS
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write(fastq_text())
    assert fastq.fastq(spark, str(tmp_path / "c.fq.gz")).count() == 4
    for bad in ("", "r\nA\n+\nI\n", "@r\nA\n-\nI\n", "@r\nAC\n+\nI\n", "@r\nAC\n+\n"):
        with pytest.raises(fasta.FormatError):
            list(fastq.records(iter(x.encode() for x in bad.splitlines(True))))
    assert cli.main(["fastq", str(tmp_path / "a.fq"), "-x", "0", "-o", str(tmp_path)]) == 0
    assert (tmp_path / "a_telomeric.fastq").read_text() == "".join("\n".join((h, s, "+", "I" * len(s))) + "\n" for h, s in (READS[0], READS[2]))


def record(name: str, seq: str) -> bytes:
    n, packed = name.encode() + b"\0", [bam._BASES.index(c) for c in seq + "=" * (len(seq) % 2)]
    core = struct.pack("<iiBBHHHiiii", -1, -1, len(n), 255, 4680, 0, 4, len(seq), -1, -1, 0)
    body = core + n + bytes(a << 4 | b for a, b in zip(packed[::2], packed[1::2], strict=True)) + b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


HEAD = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)


def test_bam(spark, tmp_path):
    raws = [record(h[1:].split()[0], s.upper()) for h, s in READS] + [record("none", "")]
    data = HEAD + b"".join(raws)
    (tmp_path / "x.bam").write_bytes(bgzf.pack(data) + bgzf.EOF)
    rows = bam.bam(spark, str(tmp_path / "x.bam")).orderBy("idx").collect()
    assert [bytes(r["raw"]) for r in rows] == raws and [r["seq"] for r in rows] == [s.upper() for _, s in READS] + [""] and [r["has_seq"] for r in rows] == [True] * 4 + [False]
    assert cli.main(["bam", str(tmp_path / "x.bam"), "-x", "0", "-o", str(tmp_path)]) == 0
    out = b"".join(bgzf.blocks(open(tmp_path / "x_telomeric.bam", "rb")))
    assert out == HEAD + raws[0] + raws[2]


def test_broken_bam(tmp_path):
    good = bgzf.pack(HEAD + record("r", "ACGT")) + bgzf.EOF
    rng = random.Random(3)
    broken = [good[:n] for n in (1, 20, len(good) // 2)] + [bgzf.pack(HEAD[:5]), bgzf.pack(b"BAM\2" + HEAD[4:]), bgzf.pack(HEAD + struct.pack("<i", 10) + bytes(10)), bgzf.pack(HEAD + record("r", "ACGT")[:-3]), b"hello world, this is no BGZF"]
    for _ in range(48):
        x = bytearray(good[: -len(bgzf.EOF)])
        x[rng.randrange(len(x))] ^= 1 << rng.randrange(8)
        broken.append(bytes(x))
    for i, data in enumerate(broken):
        at = tmp_path / f"{i}.bam"
        at.write_bytes(data)
        try:
            with open(at, "rb") as f:
                r = bgzf.Reader(f)
                bam.header(r)
                list(bam.records(r))
        except fasta.FormatError:
            continue
        assert i >= 8  # a flipped bit may lie where nothing depends on it
    big = random.Random(1).randbytes(200_000)
    assert b"".join(bgzf.blocks(__import__("io").BytesIO(bgzf.pack(big)))) == big


GRAPH = "\n".join(["H\tVN:Z:1.0", *(f"S\t{n}\t{s}" for n, s in (("fp", "CCCTAA" * 12 + "ACGT" * 50), ("lp", "ACGT" * 50 + "TTAGGG" * 12), ("fn", "ACGT" * 50 + "TTAGGG" * 12), ("ln", "CCCTAA" * 12 + "ACGT" * 50), ("none", "*"))), "L\tfp\t+\tlp\t+\t0M", "P\tone\tfp+,lp+\t*", "P\ttwo\tfn-,ln-\t*"]) + "\n"


def test_gfa(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(GRAPH)
    c = ScanConfig(edit_distance=0, min_block_length=60)
    lines = gfa.checked(gfa.gfa_lines(spark, str(tmp_path / "g.gfa")))
    got = sorted(tuple(r) for r in graph.caps(gfa.segments(lines), c, path_ends(gfa.paths(lines))).collect())
    assert got == sorted([("telomere_fp+_start", "fp", "start", "+", "+", 72), ("telomere_lp+_end", "lp", "end", "+", "-", 72), ("telomere_fn-_start", "fn", "start", "-", "-", 72), ("telomere_ln-_end", "ln", "end", "-", "+", 72)])
    plain = sorted(tuple(r)[1:3] for r in graph.caps(gfa.segments(lines), c).collect())
    assert plain == [("fn", "end"), ("fp", "start"), ("ln", "start"), ("lp", "end")]
    assert cli.main(["gfa", str(tmp_path / "g.gfa"), "-x", "0", "-l", "60", "-o", str(tmp_path)]) == 0
    out = (tmp_path / "g.gfa.telo.annotated.gfa").read_text().splitlines()
    assert out[: len(GRAPH.splitlines())] == GRAPH.splitlines() and sum(x.startswith("S\ttelomere_") for x in out) == 4 and "L\ttelomere_lp+_end\t+\tlp\t-\t0M\tRC:i:0" in out
    for bad in ("H\tVN:Z:2.0\n", "S\ta\n", "W\tx\ty\n", "S\ta\t100\tACGT\n"):
        (tmp_path / "bad.gfa").write_text(bad)
        with pytest.raises(fasta.FormatError, match="line 1"):
            gfa.checked(gfa.gfa_lines(spark, str(tmp_path / "bad.gfa")))


def test_tables(spark, tmp_path):
    (tmp_path / "s.txt").write_text("﻿# c\nchr1\n\nchr2\t0\t10\n")
    assert sorted(r[0] for r in tables.selectors(spark, str(tmp_path / "s.txt")).collect()) == ["chr1", "chr2"]
    for bad in ("a\tb\n", "a\t5\t1\n", "a\tx\t1\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(ValueError, match="neither"):
            tables.selectors(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "x.bedgraph").write_text("track x\nc\t0\t10\t0.5\nc\t10\t10\t1\nc\t10\t20\tnan\nc\t20\t30\t-1\n")
    assert [tuple(r) for r in tables.bedgraph(spark, str(tmp_path / "x.bedgraph")).collect()] == [("c", 0, 10, 0.5), ("c", 20, 30, -1.0)]
    (tmp_path / "t.tsv").write_text("# truth\nc\t100\t0\t10\t10\t12\t80\t85\t90\t100\n")
    assert [tuple(r) for r in tables.truth(spark, str(tmp_path / "t.tsv")).collect()] == [("c", "p", 0, 10), ("c", "q", 90, 100)]


def test_scan_files(spark, tmp_path):
    seqs = {"t2t": "CCCTAA" * 100 + "ACGATCGATCG" * 180 + "TTAGGG" * 100, "gapped": "ACGT" * 100 + "N" * 100 + "ACGT" * 50}
    (tmp_path / "a.fa").write_text("".join(f">{k}\n{v}\n" for k, v in seqs.items()))
    assert cli.main(["scan", str(tmp_path / "a.fa"), "-o", str(tmp_path), "-r", "-g", "-e", "-m", "-i"]) == 0
    assert (tmp_path / "a.fa_gaps.bed").read_text() == "gapped\t400\t500\n"
    bed = (tmp_path / "a.fa_terminal_telomeres.bed").read_text().splitlines()
    assert [x.split("\t")[:5] for x in bed] == [["t2t", "0", "600", "600", "p"], ["t2t", "2580", "3180", "600", "q"]] and bed[0].endswith("\tscaffold")
    report = (tmp_path / "a.fa_report.tsv").read_text()
    assert "1\tt2t\t2\tpq\t0\tt2t\tPQ\t0\t" in report and "Gapped no telomeres:\t1" in report and "Mean length:\t600" in report
    assert [tuple(r)[:6] for r in tables.report(spark, str(tmp_path / "a.fa_report.tsv")).orderBy("pos").collect()] == [(1, "t2t", "2", "pq", "0", "t2t"), (2, "gapped", "0", "none", "1", "gapped_none")]
    assert tables.block_bed(spark, str(tmp_path / "a.fa_terminal_telomeres.bed")).count() == 2
    assert (tmp_path / "a.fa_window_gc.bedgraph").read_text().startswith("track ")
    (tmp_path / "ids").write_text("t2t\n")
    assert cli.main(["scan", str(tmp_path / "a.fa"), "-o", str(tmp_path), "--include-file", str(tmp_path / "ids")]) == 0
    assert "Total paths:\t1" in (tmp_path / "a.fa_report.tsv").read_text()
    (tmp_path / "ids").write_text("nope\n")
    assert cli.main(["scan", str(tmp_path / "a.fa"), "-o", str(tmp_path), "--include-file", str(tmp_path / "ids")]) == 1


def test_ordered_parts(spark, tmp_path):
    lines = spark.range(1000).selectExpr("id seq_pos", "cast(id as string) line").repartition(7)
    files.write_ordered(lines, str(tmp_path / "x"), parts=4)
    files.one_file(str(tmp_path / "x"), str(tmp_path / "y"), "head\n")
    assert (tmp_path / "y").read_text() == "head\n" + "".join(f"{i}\n" for i in range(1000))
