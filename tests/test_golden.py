"""All expected path rows of FIXTURES.md, one scan for each set of flags."""

from __future__ import annotations

from collections import defaultdict

import pytest
from fixtures import goldens, recipes
from pyspark.sql import functions as F

from motifold.config import ScanConfig
from motifold.operators import summary
from motifold.operators.classify import with_longest
from motifold.plans.scan import Scan

VALUES = {"-w": ("window", int), "-s": ("step", int), "-t": ("terminal_limit", int), "-x": ("edit_distance", int), "-k": ("max_match_distance", int), "-l": ("min_block_length", int), "-d": ("max_block_distance", int), "-y": ("min_block_density", float), "-c": ("canonical", str), "-p": ("patterns", lambda x: tuple(x.split(",")))}
SWITCHES = {"-r": "repeats", "-g": "gc", "-e": "entropy", "-m": "matches", "-i": "its", "-n": "manual_curation"}


def config(flags: str) -> ScanConfig:
    options, words = {}, flags.split()
    while words:
        flag = words.pop(0)
        if flag in SWITCHES:
            options[SWITCHES[flag]] = True
        else:
            name, kind = VALUES[flag]
            options[name] = kind(words.pop(0))
    return ScanConfig(**options)


BY_FLAGS = defaultdict(list)
for _g in goldens():
    BY_FLAGS[_g["flags"]].append(_g)


def test_all_are_here():
    assert sum(map(len, BY_FLAGS.values())) == 144


@pytest.mark.parametrize("flags", sorted(BY_FLAGS))
def test_rows(spark, flags):
    known, cfg = recipes(), config(flags)
    rows = []
    for g in BY_FLAGS[flags]:
        for i, seq in enumerate(known[g["fixture"]]):
            rows.append((i, f"{g['fixture']}#{i}", seq))
    scan = Scan(spark.createDataFrame(rows, "seq_pos long, header string, seq string"), cfg)
    got = {r["header"]: r for r in scan.path_summary.collect()}
    name = F.regexp_extract("header", "^(.*)#", 1).alias("fixture")
    contig = dict(summary.n50(scan.contigs.withColumn("fixture", name), "contig_len", ["fixture"]).collect())
    path = dict(summary.n50(scan.path_summary.withColumn("fixture", name), "path_size", ["fixture"]).collect())
    mean = dict(with_longest(scan.terminal_blocks).where("is_longest").groupBy(name).agg(F.avg("length")).collect())
    for g in BY_FLAGS[flags]:
        for i, want in enumerate(g["rows"]):
            r = got[f"{g['fixture']}#{i}"]
            cells = [str(i + 1), str(r["telomeres"]), r["labels"], str(r["gaps"]), r["type"], r["granular"]]
            if cfg.full:
                cells += [str(r["its"]), str(r["canonical"]), str(r["windows"])]
            expected = want.split()
            assert [c for c in cells if c] == [expected[0], *expected[2:]], (g["fixture"], flags)
        assert (path[g["fixture"]], contig[g["fixture"]]) == (g["scaffold_n50"], g["contig_n50"])
        assert g["mean"] is None or abs(mean[g["fixture"]] - g["mean"]) < 0.5 + 1e-6 * g["mean"], g
