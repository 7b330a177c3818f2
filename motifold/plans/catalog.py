"""The queries of the engine's own operators by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import columns as X
from ..functions import tables as table_functions
from ..operators import blocks as B
from ..operators import classify, graph, intervals, islands, matches, reads, report, select, summary, tracks
from ..operators import contigs as C
from .derive import PARTS, PATHS, SEQUENCES, blocks, hits, sequences, table
from .scan import Scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EXACT = ScanConfig(edit_distance=0, min_block_length=100, whole=True)
TIPS = ScanConfig(edit_distance=0, min_block_length=100, terminal_limit=300)
FULL = ScanConfig(edit_distance=0, min_block_length=100, terminal_limit=300, its=True, repeats=True)
SLIDING = ScanConfig(edit_distance=0, window=200, step=100, repeats=True)
NEAR = ScanConfig(edit_distance=1, terminal_limit=300, matches=True)

ALL_HITS, TIP_HITS, WINDOW_HITS = "TRUE", "n <= 600 OR pos + 6 <= 300 OR pos >= n - 300", "pos + 6 <= pos // 1000 * 1000 + 1000"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def chain(select_: str, *ctes: str) -> str:
    return f"WITH {','.join((SEQUENCES, *ctes))} {select_}"


def scan(spark: SparkSession, sf: str, config: ScanConfig) -> Scan:
    return Scan(sequences(spark, sf), config)


ALL = (PARTS, hits(ALL_HITS), blocks(50_000, 100))
SHORT = (PARTS, hits(TIP_HITS), blocks(300, 100))
WHOLE = (PARTS, hits(WINDOW_HITS), blocks(300, 100))


# matches and scalar functions ----------------------------------------------------------------------------------------


@query("motif_hits_exact", chain("SELECT doc_id, contig_start + pos AS pos, f AS is_forward FROM hits", PARTS, hits(ALL_HITS)))
def motif_hits_exact(spark, sf):
    return scan(spark, sf, EXACT).matches.select(F.col("seq_pos").alias("doc_id"), F.col("abs_pos").alias("pos"), "is_forward")


_NEIGHBOURS = ", ".join(f"('{p.pattern}', {p.is_forward}, {p.is_canonical})" for p in ScanConfig(edit_distance=1).expanded())


@query(
    "motif_hits_edit1",
    chain(
        f"""SELECT doc_id, count(*) AS n, sum(f::INT)::BIGINT AS n_forward, sum(c::INT)::BIGINT AS n_canonical, sum(contig_start + t0 + o)::BIGINT AS sum_pos
FROM (SELECT doc_id, contig_start, t0, o, substr(tile, o + 1, 6) AS k FROM tiles, unnest(range(least(500, length(tile) - 5))) AS u(o)) JOIN (VALUES {_NEIGHBOURS}) AS v(m, f, c) ON k = m GROUP BY doc_id""",
        PARTS,
        "tiles AS (SELECT doc_id, contig_start, t0, substr(bases, t0 + 1, 505) AS tile FROM contigs, unnest(range(0, n, 500)) AS u(t0) WHERE n - t0 >= 6)",
    ),
)
def motif_hits_edit1(spark, sf):
    s = scan(spark, sf, ScanConfig(edit_distance=1))
    found = matches.matches(s.contigs, s.config.expanded())
    one = lambda c: F.sum(F.col(c).cast("long"))
    return found.groupBy(F.col("seq_pos").alias("doc_id")).agg(F.count("*").alias("n"), one("is_forward").alias("n_forward"), one("is_canonical").alias("n_canonical"), F.sum("abs_pos").alias("sum_pos"))


@query("scan_motifs_udtf", chain("SELECT doc_id, contig_start + pos AS pos, f AS is_forward FROM hits", PARTS, hits(ALL_HITS)))
def scan_motifs_udtf(spark, sf):
    """The table function over whole sequences: gaps hold no match, so places are those of their contigs' matches."""
    table_functions.register(spark, EXACT, "scan_exact_motifs")
    sequences(spark, sf).createOrReplaceTempView("motifold_sequences")
    return spark.sql("SELECT seq_pos AS doc_id, m.pos, m.is_forward FROM motifold_sequences, LATERAL scan_exact_motifs(seq) AS m")


@query("revcomp_project", chain("SELECT doc_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS digest FROM seqs"))
def revcomp_project(spark, sf):
    return sequences(spark, sf).select(F.col("seq_pos").alias("doc_id"), F.md5(X.reverse_complement(F.col("seq")).cast("binary")).alias("digest"))


_COUNTS = ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS n_{b.lower()}" for b in "ACGT")
_ENTROPY = " + ".join(f"CASE WHEN n_{b} > 0 THEN n_{b} / size * log2(n_{b} / size) ELSE 0 END" for b in "acgt")


@query("base_composition", chain(f"SELECT doc_id, n_a, n_c, n_g, n_t, CASE WHEN size > 0 THEN round((n_c + n_g) * 100.0 / size, 6) END AS gc, round(-({_ENTROPY}), 3) + 0.0 AS entropy FROM (SELECT doc_id, length(seq)::DOUBLE AS size, {_COUNTS} FROM seqs)"))
def base_composition(spark, sf):
    size = F.length("seq").cast("long")
    n = {b: X.base_count(F.col("seq"), b.upper()) for b in "acgt"}
    return sequences(spark, sf).select(F.col("seq_pos").alias("doc_id"), *(c.alias(f"n_{b}") for b, c in n.items()), F.round(X.gc_percent(n["c"], n["g"], size), 6).alias("gc"), X.entropy(list(n.values()), size).alias("entropy"))


@query(
    "hamming_kmers",
    chain(
        """SELECT doc_id, least(hamming(k, 'CCCTAA'), hamming(k, 'TTAGGG'))::INT AS distance, count(*) AS n
FROM (SELECT doc_id, substr(tile, o + 1, 6) AS k FROM tiles, unnest(range(least(500, length(tile) - 5))) AS u(o)) GROUP BY ALL""",
        PARTS,
        "tiles AS (SELECT doc_id, substr(bases, t0 + 1, 505) AS tile FROM contigs, unnest(range(0, n, 500)) AS u(t0) WHERE n - t0 >= 6)",
    ),
)
def hamming_kmers(spark, sf):
    """Every 6-mer of every contig, counted by document and distance to the nearer canonical repeat."""
    return matches.distance_counts(scan(spark, sf, EXACT).contigs, ["CCCTAA", "TTAGGG"]).select(F.col("seq_pos").alias("doc_id"), "distance", "n")


# contigs, islands, blocks --------------------------------------------------------------------------------------------


@query("contig_runs", chain("SELECT doc_id, contig_start AS s, contig_start + n AS e FROM contigs", PARTS))
def contig_runs(spark, sf):
    return scan(spark, sf, EXACT).contigs.select(F.col("seq_pos").alias("doc_id"), F.col("contig_start").alias("s"), (F.col("contig_start") + F.col("contig_len")).alias("e"))


@query("gap_runs", chain("SELECT doc_id, s, e FROM gaps", PARTS))
def gap_runs(spark, sf):
    return scan(spark, sf, EXACT).gaps.select(F.col("seq_pos").alias("doc_id"), F.col("start").alias("s"), F.col("end").alias("e"))


@query("match_islands", chain("SELECT doc_id, contig_no::INT AS contig_no, f AS is_forward, s, e, c AS n FROM islands", *ALL))
def match_islands(spark, sf):
    s = scan(spark, sf, EXACT)
    return B.strand_islands(s.matches, EXACT).select(F.col("seq_pos").alias("doc_id"), "contig_no", F.col("strand").alias("is_forward"), F.col("start").alias("s"), F.col("end").alias("e"), "n")


_BLOCK = "doc_id, contig_no::INT AS contig_no, label, s, e, length, c AS n, valid, terminal"


def _blocks(df: DataFrame) -> DataFrame:
    n = (F.col("forward_count") + F.col("reverse_count")).alias("n")
    return df.select(F.col("seq_pos").alias("doc_id"), "contig_no", "label", F.col("start").alias("s"), F.col("end").alias("e"), "length", n, F.col("valid_orientation").alias("valid"), F.col("scaffold_terminal").alias("terminal"))


@query("terminal_blocks", chain(f"SELECT {_BLOCK} FROM blocks", *ALL))
def terminal_blocks(spark, sf):
    return _blocks(scan(spark, sf, EXACT).terminal_blocks)


@query("terminal_blocks_tips", chain(f"SELECT {_BLOCK} FROM blocks", *SHORT))
def terminal_blocks_tips(spark, sf):
    return _blocks(scan(spark, sf, TIPS).terminal_blocks)


@query("scaffold_terminal_filter", chain(f"SELECT {_BLOCK} FROM blocks WHERE terminal", *SHORT))
def scaffold_terminal_filter(spark, sf):
    return _blocks(scan(spark, sf, TIPS).terminal_blocks).where("terminal")


@query("valid_orientation", chain("SELECT label, valid, count(*) AS n FROM blocks GROUP BY ALL", *ALL))
def valid_orientation(spark, sf):
    return scan(spark, sf, EXACT).terminal_blocks.groupBy("label", F.col("valid_orientation").alias("valid")).agg(F.count("*").alias("n"))


_ITS = """
inner_part AS (SELECT c.doc_id, c.contig_no, coalesce(max(b.e) FILTER (label = 'p'), any_value(c.contig_start)) AS lo, coalesce(min(b.s) FILTER (label = 'q'), any_value(c.contig_start + c.n)) AS hi
               FROM contigs c LEFT JOIN blocks b USING (doc_id, contig_no) GROUP BY ALL),
inside AS (SELECT h.*, h.contig_start + h.pos AS abs_pos FROM hits h JOIN inner_part i USING (doc_id, contig_no) WHERE lo < hi AND h.contig_start + h.pos >= lo AND h.contig_start + h.pos < hi),
its_brk AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc_id, contig_no ORDER BY pos) > 50 AS b FROM inside),
its_num AS (SELECT *, sum(coalesce(b, TRUE)::INT) OVER (PARTITION BY doc_id, contig_no ORDER BY pos) AS island FROM its_brk),
its AS (SELECT doc_id, path_size, contig_no, min(abs_pos) AS s, max(abs_pos) + 6 AS e, count(*) AS c, sum(f::INT) AS fw FROM its_num GROUP BY doc_id, path_size, contig_no, island HAVING count(*) >= 4 AND max(abs_pos) + 6 - min(abs_pos) >= 12),
its_labelled AS (SELECT *, CASE WHEN (fw * 100.0 / c)::FLOAT > 66.6::FLOAT THEN 'p' WHEN (fw * 100.0 / c)::FLOAT < 33.3::FLOAT THEN 'q' ELSE 'b' END AS label FROM its)"""


@query("its_blocks", chain("SELECT doc_id, contig_no::INT AS contig_no, label, s, e, c AS n FROM its_labelled", *WHOLE, _ITS))
def its_blocks(spark, sf):
    return scan(spark, sf, FULL).interstitial_blocks.select(F.col("seq_pos").alias("doc_id"), "contig_no", "label", F.col("start").alias("s"), F.col("end").alias("e"), (F.col("forward_count") + F.col("reverse_count")).alias("n"))


@query("its_labels", chain("SELECT label, count(*) AS n FROM its_labelled GROUP BY label", *WHOLE, _ITS))
def its_labels(spark, sf):
    return scan(spark, sf, FULL).interstitial_blocks.groupBy("label").agg(F.count("*").alias("n"))


# windows -------------------------------------------------------------------------------------------------------------


def _windows_sql(window: int, step: int, columns: str) -> str:
    count = ", ".join(f"length(b) - length(replace(b, '{x}', '')) AS n_{x.lower()}" for x in "ACGT")
    return chain(
        f"SELECT doc_id, s, s + size AS e, {columns} FROM joined",
        PARTS,
        hits(f"pos + 6 <= pos // {step} * {step} + {window}"),
        f"""
win AS (SELECT doc_id, contig_no, contig_start + k * {step} AS s, k, substr(bases, (k * {step} + 1)::INT, {window}) AS b FROM contigs, unnest(range((n - 1) // {step} + 1)) AS u(k)),
sized AS (SELECT doc_id, contig_no, s, k, length(b) AS size, {count} FROM win),
held AS (SELECT doc_id, contig_no, f, unnest(range(greatest(0, ceil((pos + 6 - {window}) / {step}))::BIGINT, pos // {step} + 1)) AS k FROM hits),
sums AS (SELECT doc_id, contig_no, k, 6 * count(*) FILTER (f) AS fc, 6 * count(*) FILTER (NOT f) AS rc FROM held GROUP BY ALL),
joined AS (SELECT z.*, coalesce(fc, 0) AS fc, coalesce(rc, 0) AS rc FROM sized z LEFT JOIN sums USING (doc_id, contig_no, k))""",
    )


_DENSITY = "round((fc + rc) / size, 6) AS density, CASE WHEN fc + rc > 0 THEN 1.0 ELSE -1.0 END AS canonical_ratio, CASE WHEN fc + rc > 0 THEN round(fc / (fc + rc), 6) ELSE -1.0 END AS strand_ratio"


def _windows(spark, sf, config: ScanConfig, *names: str) -> DataFrame:
    return scan(spark, sf, config).windows.select(F.col("seq_pos").alias("doc_id"), F.col("start").alias("s"), F.col("end").alias("e"), *(F.round(n, 6).alias(n) for n in names))


@query("window_repeats", _windows_sql(1000, 1000, _DENSITY))
def window_repeats(spark, sf):
    return _windows(spark, sf, FULL, "density", "canonical_ratio", "strand_ratio")


@query("window_gc_entropy", _windows_sql(1000, 1000, f"round((n_c + n_g) * 100.0 / size, 6) AS gc, round(-({_ENTROPY}), 3) + 0.0 AS entropy"))
def window_gc_entropy(spark, sf):
    return _windows(spark, sf, FULL, "gc", "entropy")


@query("window_sliding_overlap", _windows_sql(200, 100, _DENSITY))
def window_sliding_overlap(spark, sf):
    return _windows(spark, sf, SLIDING, "density", "canonical_ratio", "strand_ratio")


@query(
    "noncanonical_terminal_matches",
    chain(
        f"""SELECT doc_id, contig_start + t0 + o AS pos, k AS seq FROM (SELECT *, substr(tile, o + 1, 6) AS k FROM tiles, unnest(range(least(500, length(tile) - 5))) AS u(o)) JOIN (VALUES {_NEIGHBOURS}) AS v(m, f, c) ON k = m
WHERE NOT c AND t0 + o + 6 <= (t0 + o) // 1000 * 1000 + 1000 AND (t0 + o <= 300 OR t0 + o >= greatest(n - 300, 0))""",
        PARTS,
        "tiles AS (SELECT doc_id, contig_start, n, t0, substr(bases, t0 + 1, 505) AS tile FROM contigs, unnest(range(0, n, 500)) AS u(t0) WHERE n - t0 >= 6)",
    ),
)
def noncanonical_terminal_matches(spark, sf):
    return matches.near_ends(scan(spark, sf, NEAR).matches, 300).select(F.col("seq_pos").alias("doc_id"), F.col("abs_pos").alias("pos"), "seq")


# classes and summaries -----------------------------------------------------------------------------------------------


@query("longest_arm", chain("SELECT doc_id, label, s, length, c * 6 AS canonical_covered FROM ranked WHERE longest", *SHORT, PATHS))
def longest_arm(spark, sf):
    return classify.with_longest(scan(spark, sf, TIPS).terminal_blocks).where("is_longest").select(F.col("seq_pos").alias("doc_id"), "label", F.col("start").alias("s"), "length", "canonical_covered")


_PATH = "doc_id, path_size, telomeres, labels, gaps, type, granular"


def _paths(s: Scan) -> DataFrame:
    return s.path_summary.withColumnRenamed("seq_pos", "doc_id").drop("header")


@query("path_summary", chain(f"SELECT {_PATH} FROM paths", *ALL, PATHS))
def path_summary(spark, sf):
    return _paths(scan(spark, sf, EXACT))


@query("path_summary_tips", chain(f"SELECT {_PATH} FROM paths", *SHORT, PATHS))
def path_summary_tips(spark, sf):
    return _paths(scan(spark, sf, TIPS))


@query(
    "path_summary_full",
    chain(
        f"""SELECT {_PATH}, coalesce(i.k, 0) AS its, coalesce(h.k, 0) AS canonical, coalesce(w.k, 0) AS windows FROM paths LEFT JOIN (SELECT doc_id, count(*) AS k FROM its GROUP BY 1) i USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS k FROM hits GROUP BY 1) h USING (doc_id) LEFT JOIN (SELECT doc_id, sum((n - 1) // 1000 + 1)::BIGINT AS k FROM contigs GROUP BY 1) w USING (doc_id)""",
        *WHOLE,
        PATHS,
        _ITS,
    ),
)
def path_summary_full(spark, sf):
    return _paths(scan(spark, sf, FULL))


_TYPES = "(VALUES ('t2t'), ('misassembly'), ('incomplete'), ('none'), ('discordant'), ('gapped_t2t'), ('gapped_misassembly'), ('gapped_incomplete'), ('gapped_none'), ('gapped_discordant')) AS v(type)"


@query("class_histogram", chain(f"SELECT v.type, count(p.doc_id) AS n FROM {_TYPES} LEFT JOIN paths p USING (type) GROUP BY v.type", *SHORT, PATHS))
def class_histogram(spark, sf):
    return summary.class_counts(scan(spark, sf, TIPS).path_summary)


@query("class_percentages", chain("SELECT type, n, round(100.0 * n / sum(n) OVER (), 6) AS of_all, CASE WHEN NOT type IN ('none', 'gapped_none') THEN round(100.0 * n / sum(n) FILTER (NOT type IN ('none', 'gapped_none')) OVER (), 6) END AS of_telomeric FROM (SELECT type, count(*) AS n FROM paths GROUP BY 1)", *SHORT, PATHS))
def class_percentages(spark, sf):
    return summary.class_shares(scan(spark, sf, TIPS).path_summary).select("type", "n", *(F.round(c, 6).alias(c) for c in ("of_all", "of_telomeric")))


@query("telomere_counts", chain("SELECT count(*) FILTER (type IN ('t2t', 'misassembly', 'gapped_t2t', 'gapped_misassembly')) AS two, count(*) FILTER (type IN ('incomplete', 'gapped_incomplete')) AS one, count(*) FILTER (type IN ('none', 'gapped_none')) AS zero FROM paths", *SHORT, PATHS))
def telomere_counts(spark, sf):
    return summary.telomere_counts(scan(spark, sf, TIPS).path_summary)


def _n50_sql(source: str) -> str:
    return f"(SELECT max(l) FROM (SELECT l, sum(l) OVER (ORDER BY l DESC) AS cum, sum(l) OVER () AS total FROM ({source}) WHERE l > 0) WHERE 2 * cum >= total)"


@query("n50_scaffold", chain(f"SELECT {_n50_sql('SELECT length(seq) AS l FROM seqs')} AS n50"))
def n50_scaffold(spark, sf):
    return summary.n50(sequences(spark, sf).select(F.length("seq").cast("long").alias("length")))


@query("n50_contig", chain(f"SELECT {_n50_sql('SELECT n AS l FROM contigs')} AS n50", PARTS))
def n50_contig(spark, sf):
    return summary.n50(scan(spark, sf, EXACT).contigs, "contig_len")


@query("n50_order_totals", f"SELECT {_n50_sql('SELECT floor(o_totalprice)::BIGINT AS l FROM orders')} AS n50")
def n50_order_totals(spark, sf):
    return summary.n50(table(spark, sf, "orders").select(F.floor("o_totalprice").alias("length")))


@query("telomere_stats", chain("SELECT count(*) AS n, round(avg(length), 6) AS mean, median(length) AS median, min(length) AS min, max(length) AS max FROM ranked WHERE longest", *SHORT, PATHS))
def telomere_stats(spark, sf):
    s = summary.length_stats(classify.with_longest(scan(spark, sf, TIPS).terminal_blocks).where("is_longest"))
    return s.select("n", F.round("mean", 6).alias("mean"), F.col("median").cast("double").alias("median"), "min", "max")


_CLASS_COLUMNS = ", ".join(f"count(*) FILTER (type = '{g}{c}') AS {g}{c}" for c in classify.CLASSES for g in ("", "gapped_"))


@query(
    "assembly_summary",
    chain(
        f"""SELECT count(*) AS paths, sum(gaps)::BIGINT AS gaps, sum(telomeres)::BIGINT AS telomeres, {_CLASS_COLUMNS}, {_n50_sql("SELECT length(seq) AS l FROM seqs")} AS scaffold_n50, {_n50_sql("SELECT n AS l FROM contigs")} AS contig_n50,
(SELECT round(avg(length), 6) FROM ranked WHERE longest) AS mean, (SELECT median(length) FROM ranked WHERE longest) AS median, (SELECT min(length) FROM ranked WHERE longest) AS min, (SELECT max(length) FROM ranked WHERE longest) AS max FROM paths""",
        *SHORT,
        PATHS,
    ),
)
def assembly_summary(spark, sf):
    return scan(spark, sf, TIPS).assembly_summary.withColumn("mean", F.round("mean", 6))


# selection -----------------------------------------------------------------------------------------------------------


@query("select_include_exclude", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND NOT starts_with(c_name, 'Customer#00000001')")
def select_include_exclude(spark, sf):
    orders = table(spark, sf, "orders")
    ids = lambda cond: orders.where(cond).select(F.col("o_custkey").alias("id"))
    kept = select.select(table(spark, sf, "customer"), "c_custkey", ids("o_orderpriority like '1%'"), (), ids("o_orderstatus = 'P'"))
    return select.select(kept, "c_name", exclude_prefixes=("Customer#00000001",)).select("c_custkey", "c_name")


@query("select_prefix_theta", "SELECT p_partkey, p_name, p_type FROM part WHERE (starts_with(p_type, 'STANDARD') OR starts_with(p_type, 'P') OR starts_with(p_type, 'ECO')) AND NOT starts_with(p_brand, 'Brand#1')")
def select_prefix_theta(spark, sf):
    kept = select.select(table(spark, sf, "part"), "p_type", include_prefixes=("STANDARD", "P", "ECO"))
    return select.select(kept, "p_brand", exclude_prefixes=("Brand#1",)).select("p_partkey", "p_name", "p_type")


@query("unmatched_selectors", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority LIKE '1%' AND o_orderstatus = 'P')")
def unmatched_selectors(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderpriority like '1%' and o_orderstatus = 'P'")
    return select.unmatched_ids(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), orders, "o_custkey")


@query("unmatched_prefixes", "SELECT prefix FROM (SELECT DISTINCT 'doc' || (n_nationkey * 3700 + 1) AS prefix FROM nation) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE starts_with('doc' || doc_id, prefix))")
def unmatched_prefixes(spark, sf):
    prefixes = table(spark, sf, "nation").select(F.concat(F.lit("doc"), (F.col("n_nationkey") * 3700 + 1).cast("string")).alias("prefix"))
    names = table(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("header"))
    return select.unmatched_prefixes(prefixes, names)


@query("duplicate_ids", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return select.duplicate_ids(table(spark, sf, "part"), "p_name")


# reads ---------------------------------------------------------------------------------------------------------------

_READS = (hits(ALL_HITS).replace("FROM contigs,", "FROM read_contigs,"), blocks(2147483647, 42))
_READ_CONTIGS = "read_contigs AS (SELECT doc_id, length(seq) AS path_size, 0 AS contig_no, 0 AS contig_start, length(seq) AS n, seq AS bases FROM seqs)"
READ = ScanConfig(edit_distance=0)


@query("read_filter_pass", chain("SELECT DISTINCT doc_id FROM blocks", _READ_CONTIGS, *_READS))
def read_filter_pass(spark, sf):
    return reads.passing(sequences(spark, sf).withColumnRenamed("seq_pos", "idx"), READ).select(F.col("idx").alias("doc_id"))


@query("read_filter_counts", chain("SELECT (SELECT count(*) FROM seqs) AS total, count(DISTINCT doc_id) AS kept, 0 AS missing FROM blocks", _READ_CONTIGS, *_READS))
def read_filter_counts(spark, sf):
    return reads.counts(sequences(spark, sf).withColumnRenamed("seq_pos", "idx"), READ)


# intervals and evaluation --------------------------------------------------------------------------------------------

_TRUTH = """
truth AS (SELECT 'doc' || doc_id AS chrom, CASE WHEN doc_id % 11 = 5 THEN 'q' ELSE 'p' END AS arm, 0 AS s, CASE WHEN doc_id % 11 = 5 THEN doc_id % 7 * 120 ELSE doc_id % 5 * 180 END AS e FROM seqs)"""


def _truth(spark, sf):
    d = F.col("seq_pos")
    swapped = d % 11 == 5
    return sequences(spark, sf).select("header", d, F.when(swapped, "q").otherwise("p").alias("arm"), F.lit(0).cast("long").alias("start"), F.when(swapped, d % 7 * 120).otherwise(d % 5 * 180).alias("end")).withColumnRenamed("header", "chrom")


def _calls(spark, sf):
    return scan(spark, sf, EXACT).terminal_blocks.select(F.col("header").alias("chrom"), "label", "start", "end", "length", "path_size")


@query("interval_overlap_join", chain("SELECT chrom, t.s, t.e, b.s AS b_start, b.e AS b_end, label FROM truth t JOIN blocks b ON chrom = 'doc' || doc_id AND t.s < b.e AND b.s < t.e WHERE t.s < t.e", *ALL, _TRUTH))
def interval_overlap_join(spark, sf):
    return intervals.overlap_join(_truth(spark, sf).select("chrom", "start", "end"), _calls(spark, sf), "chrom").select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "b_start", "b_end", F.col("b_label").alias("label"))


@query("interval_false_positives", chain("SELECT 'doc' || doc_id AS chrom, label, s, e FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE chrom = 'doc' || doc_id AND t.s < b.e AND b.s < t.e AND t.s < t.e)", *ALL, _TRUTH))
def interval_false_positives(spark, sf):
    return intervals.not_overlapping(_calls(spark, sf), _truth(spark, sf), "chrom").select("chrom", "label", F.col("start").alias("s"), F.col("end").alias("e"))


@query(
    "evaluator_metrics",
    chain(
        """SELECT count(*) AS truths, count(called) AS found, round(count(called) / count(*), 6) AS sensitivity, round(avg(called - (e - s)), 6) AS mean_bias, round(avg(abs(called - (e - s))), 6) AS mean_absolute_error,
(SELECT count(*) FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE chrom = 'doc' || doc_id AND t.s < b.e AND b.s < t.e AND t.s < t.e)) AS false_positives
FROM (SELECT t.chrom, t.s, t.e, max(b.length) AS called FROM truth t LEFT JOIN blocks b ON chrom = 'doc' || doc_id AND label = arm AND t.s < b.e AND b.s < t.e AND t.s < t.e GROUP BY ALL)""",
        *ALL,
        _TRUTH,
    ),
)
def evaluator_metrics(spark, sf):
    e = intervals.evaluation(_truth(spark, sf), _calls(spark, sf))
    return e.withColumns({c: F.round(c, 6) for c in ("sensitivity", "mean_bias", "mean_absolute_error")})


# paths and graphs ----------------------------------------------------------------------------------------------------


@query("path_offsets", "SELECT l_orderkey AS path_id, l_linenumber AS idx, coalesce(sum(p_size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, p_size AS length FROM (SELECT l_orderkey, l_linenumber, max(p_size)::BIGINT AS p_size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)")
def path_offsets(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("ref_id"), F.col("p_size").cast("long").alias("length"))
    paths = table(spark, sf, "lineitem").join(parts.withColumnRenamed("ref_id", "l_partkey"), "l_partkey").groupBy(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("idx")).agg(F.max(F.struct("length", "l_partkey"))["l_partkey"].alias("ref_id"))
    walked = C.path_walk(paths.withColumns({"kind": F.lit("S"), "orient": F.lit("+")}), parts, parts.limit(0))
    return walked.select("path_id", "idx", F.col("start").alias("s"), "length")


@query("path_ends", "SELECT DISTINCT ref_id, orient, is_first FROM (SELECT min_by(l_partkey, l_linenumber) AS ref_id, min_by(o, l_linenumber) AS orient, TRUE AS is_first FROM x GROUP BY l_orderkey UNION ALL SELECT max_by(l_partkey, l_linenumber), max_by(o, l_linenumber), FALSE FROM x GROUP BY l_orderkey)".replace("FROM x", "FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, CASE WHEN max(l_partkey) % 2 = 0 THEN '+' ELSE '-' END AS o FROM lineitem GROUP BY 1, 2)"))
def path_ends(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("idx")).agg(F.max("l_partkey").alias("ref_id"))
    return C.path_ends(x.withColumns({"kind": F.lit("S"), "orient": F.when(F.col("ref_id") % 2 == 0, "+").otherwise("-")}))


_SEGMENTS = _READ_CONTIGS
_SEGMENT_BLOCKS = (hits("n <= 100000 OR pos + 6 <= 50000 OR pos >= n - 50000").replace("FROM contigs,", "FROM read_contigs,"), blocks(50_000, 100))
_ENDS = "ends AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS orient, doc_id % 4 < 2 AS is_first FROM seqs)"


def _segments(spark, sf):
    return sequences(spark, sf).select(F.col("header").alias("segment"), "seq")


@query("graph_caps_pathless", chain("SELECT 'telomere_doc' || doc_id || '+_' || role AS node, role, CASE role WHEN 'start' THEN '+' ELSE '-' END AS link_orient, max(length) AS length FROM (SELECT *, CASE WHEN s <= n - e THEN 'start' ELSE 'end' END AS role FROM blocks) GROUP BY doc_id, role", _SEGMENTS, *_SEGMENT_BLOCKS))
def graph_caps_pathless(spark, sf):
    return graph.caps(_segments(spark, sf), EXACT).select("node", "role", "link_orient", "length")


@query("graph_caps_paths", chain("SELECT 'telomere_doc' || doc_id || orient || '_' || CASE WHEN is_first THEN 'start' ELSE 'end' END AS node, orient AS path_orient, CASE WHEN is_first THEN orient WHEN orient = '+' THEN '-' ELSE '+' END AS link_orient, max(length) AS length FROM blocks JOIN ends USING (doc_id) WHERE (s <= n - e) = (is_first = (orient = '+')) GROUP BY doc_id, orient, is_first", _SEGMENTS, *_SEGMENT_BLOCKS, _ENDS))
def graph_caps_paths(spark, sf):
    d = F.col("seq_pos")
    ends = sequences(spark, sf).select(F.col("header").alias("ref_id"), F.when(d % 2 == 0, "+").otherwise("-").alias("orient"), (d % 4 < 2).alias("is_first"))
    return graph.caps(_segments(spark, sf), EXACT, ends).select("node", "path_orient", "link_orient", "length")


# report --------------------------------------------------------------------------------------------------------------


@query("chrom_sizes_union", chain("SELECT 'doc' || doc_id AS chrom, max(z) AS size FROM (SELECT doc_id, greatest(path_size, e) AS z FROM blocks UNION ALL SELECT doc_id, e FROM gaps) GROUP BY doc_id", *ALL))
def chrom_sizes_union(spark, sf):
    return report.chrom_sizes(_calls(spark, sf), scan(spark, sf, EXACT).gaps.withColumnRenamed("header", "chrom"))


_SIZES = "sizes AS (SELECT 'doc' || doc_id AS chrom, length(seq) AS size FROM seqs)"
_ROWS = "rows AS (SELECT 'doc' || doc_id AS chrom, label, s, e, length, CASE label WHEN 'p' THEN s ELSE greatest(path_size - e, 0) END AS distance FROM blocks)"


def _sizes(spark, sf):
    return sequences(spark, sf).select(F.col("header").alias("chrom"), F.length("seq").cast("long").alias("size"))


def _rows(spark, sf):
    return report.block_rows(_calls(spark, sf), _sizes(spark, sf))


@query("end_distance", chain("SELECT chrom, label, s, distance, distance > 1000 AS flagged FROM rows", *ALL, _ROWS))
def end_distance(spark, sf):
    return _rows(spark, sf).select("chrom", "label", F.col("start").alias("s"), "distance", "flagged")


@query("top_flagged_scaffolds", chain("SELECT 'doc' || doc_id AS chrom, type, path_size AS size FROM paths WHERE type IN ('misassembly', 'gapped_misassembly', 'discordant', 'gapped_discordant') AND path_size > 0 ORDER BY size DESC, chrom LIMIT 10", *ALL, PATHS))
def top_flagged_scaffolds(spark, sf):
    classes = scan(spark, sf, EXACT).path_summary.select(F.col("header").alias("chrom"), "type")
    return report.flagged_scaffolds(classes, _sizes(spark, sf)).select("chrom", "type", "size")


@query("flagged_by_scaffold", chain("SELECT chrom, sum(length)::BIGINT AS bp, count(*) AS n, (SELECT label FROM (SELECT label, count(*) AS k, min(s) AS t0 FROM rows x WHERE x.chrom = r.chrom AND distance > 1000 GROUP BY label ORDER BY k DESC, t0 LIMIT 1)) AS arm FROM rows r WHERE distance > 1000 GROUP BY chrom ORDER BY bp DESC, chrom LIMIT 10", *ALL, _ROWS))
def flagged_by_scaffold(spark, sf):
    return report.flagged_by_scaffold(_rows(spark, sf))


@query("tukey_outliers", "SELECT o_orderkey, v > hi + 1.5 * (hi - lo) OR v < lo - 1.5 * (hi - lo) AS outlier FROM (SELECT o_orderkey, o_orderstatus, o_totalprice AS v FROM orders) JOIN (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM orders GROUP BY 1) USING (o_orderstatus)")
def tukey_outliers(spark, sf):
    return report.outliers(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"]).select("o_orderkey", "outlier")


_VIEW = """
view AS (SELECT 'doc' || doc_id AS chrom, max(path_size) AS z, max(e) FILTER (label IN ('p', 'b')) AS p, max(path_size - s) FILTER (label IN ('q', 'b')) AS q FROM blocks GROUP BY doc_id),
kb AS (SELECT chrom, z, CASE WHEN z <= 1000 THEN CASE WHEN p IS NOT NULL THEN z END ELSE least(z, (ceil(least(z, greatest(2 * p, 1000)) / 1000) * 1000)::BIGINT + CASE WHEN p IS NULL THEN NULL ELSE 0 END) END AS pl,
              CASE WHEN z <= 1000 THEN CASE WHEN q IS NOT NULL THEN z END ELSE least(z, (ceil(least(z, greatest(2 * q, 1000)) / 1000) * 1000)::BIGINT + CASE WHEN q IS NULL THEN NULL ELSE 0 END) END AS ql FROM view),
arms AS (SELECT chrom, z, CASE WHEN p IS NOT NULL THEN pl END AS pw, CASE WHEN q IS NOT NULL THEN ql END AS qw FROM kb JOIN view USING (chrom, z)),
views AS (SELECT chrom, z, CASE WHEN pw IS NULL OR qw IS NULL OR greatest(pw, qw) <= 5 * least(pw, qw) THEN greatest(coalesce(pw, qw), coalesce(qw, pw)) ELSE pw END AS pv,
                 CASE WHEN pw IS NULL OR qw IS NULL OR greatest(pw, qw) <= 5 * least(pw, qw) THEN greatest(coalesce(pw, qw), coalesce(qw, pw)) ELSE qw END AS qv FROM arms)"""


@query("view_windows", chain("SELECT chrom, 0 AS p_start, pv AS p_end, greatest(z - qv, 0) AS q_start, z AS q_end FROM views WHERE pv IS NOT NULL", *ALL, _VIEW))
def view_windows(spark, sf):
    return report.view_windows(_calls(spark, sf))


@query("view_clip", chain("SELECT 'doc' || doc_id AS chrom, greatest(s, 100) AS s, least(e, 2500) AS e FROM gaps WHERE e > 100 AND s < 2500", PARTS))
def view_clip(spark, sf):
    return intervals.clipped(scan(spark, sf, EXACT).gaps, 100, 2500).select(F.col("header").alias("chrom"), F.col("start").alias("s"), F.col("end").alias("e"))


@query(
    "its_cluster_best",
    chain(
        """SELECT 'doc' || doc_id AS chrom, unnest(max_by(struct_pack(s := s, e := e, bp := bp, n := n), struct_pack(bp := bp, t := -s))) FROM (SELECT doc_id, min(s) AS s, max(e) AS e, sum(e - s)::BIGINT AS bp, count(*) AS n FROM
(SELECT *, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY s, e) AS g FROM (SELECT *, coalesce(s - max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 200, TRUE) AS b FROM gaps)) GROUP BY doc_id, g) GROUP BY doc_id""",
        PARTS,
    ),
)
def its_cluster_best(spark, sf):
    gaps = scan(spark, sf, EXACT).gaps.select(F.col("header").alias("chrom"), "start", "end")
    return report.best_cluster(gaps, 200).withColumnsRenamed({"start": "s", "end": "e"})


@query("strand_bias", _windows_sql(1000, 1000, "CASE WHEN fc + rc > 0 THEN round(abs(2 * fc / (fc + rc) - 1), 6) ELSE -1.0 END AS bias"))
def strand_bias(spark, sf):
    w = scan(spark, sf, FULL).windows
    return w.select(F.col("seq_pos").alias("doc_id"), F.col("start").alias("s"), F.col("end").alias("e"), F.round(X.strand_bias(F.col("strand_ratio")), 6).alias("bias"))


# what figures draw ---------------------------------------------------------------------------------------------------


@query("terminal_projection", chain("SELECT 'doc' || doc_id AS chrom, label, s, CASE label WHEN 'p' THEN s ELSE greatest(path_size - e, 0) END AS near, CASE label WHEN 'p' THEN e ELSE greatest(path_size - s, 0) END AS far FROM blocks", *ALL))
def terminal_projection(spark, sf):
    c = _calls(spark, sf)
    near, far = tracks.terminal_interval(F.col("label"), F.col("start"), F.col("end"), F.col("path_size"))
    return c.select("chrom", "label", F.col("start").alias("s"), near.alias("near"), far.alias("far"))


_POINTS = _windows_sql(1000, 1000, "CASE WHEN fc + rc > 0 THEN fc / (fc + rc) ELSE -1.0 END AS v")


@query("track_points", f"SELECT doc_id, s AS x, round(greatest(v, 0), 6) AS y FROM ({_POINTS}) UNION ALL SELECT doc_id, max_by(e, s), round(max_by(v, s), 6) FROM ({_POINTS}) GROUP BY doc_id")
def track_points(spark, sf):
    w = scan(spark, sf, FULL).windows.select(F.col("seq_pos").alias("doc_id"), "start", "end", F.col("strand_ratio").alias("value"))
    return tracks.step_points(w, ["doc_id"]).withColumn("y", F.round("y", 6))


@query("track_validity", "SELECT event_id, value IS NOT NULL AND isfinite(value - 50) AND value - 50 >= 0 AS valid, CASE WHEN value >= 50 THEN round(log10(value - 50 + 1), 6) END AS scaled, round((value - 50) / 100.0, 6) AS fraction FROM events")
def track_validity(spark, sf):
    v = F.col("value") - 50
    valid = tracks.valid_value(v)
    return table(spark, sf, "events").select("event_id", valid.alias("valid"), F.when(valid, F.round(tracks.log_plus(v), 6)).alias("scaled"), F.round(tracks.gc_fraction(v), 6).alias("fraction"))


@query("legend_labels", chain("SELECT DISTINCT 'doc' || doc_id AS chrom, label FROM blocks WHERE e > 100 AND s < 600", *ALL))
def legend_labels(spark, sf):
    return tracks.labels_in_view(_calls(spark, sf), F.lit(100), F.lit(600))


@query("panel_merge", chain("SELECT chrom, pv IS NULL OR (pv >= greatest(z - qv, 0) AND has_p AND has_q) AS merged FROM (SELECT 'doc' || doc_id AS chrom, bool_or(label IN ('p', 'b')) AS has_p, bool_or(label IN ('q', 'b')) AS has_q FROM blocks GROUP BY doc_id) LEFT JOIN views USING (chrom)", *ALL, _VIEW))
def panel_merge(spark, sf):
    c = _calls(spark, sf)
    return tracks.merged_panels(c, report.view_windows(c))


@query("glyph_fits", chain("SELECT 'doc' || doc_id AS chrom, label, s, path_size > 0 AND length / path_size::DOUBLE >= CASE label WHEN 'b' THEN 0.030 ELSE 0.018 END AS fits FROM blocks", *ALL))
def glyph_fits(spark, sf):
    return _calls(spark, sf).select("chrom", "label", F.col("start").alias("s"), tracks.glyph_fits(F.col("label"), F.col("length"), F.col("path_size")).alias("fits"))


@query(
    "axis_ticks",
    chain(
        """SELECT chrom, i, round(z * i / 4.0, 6) AS at, rtrim(rtrim(printf('%.2f', greatest(z, 1) / 1000.0 * i / 4), '0'), '.') AS arm_text FROM (SELECT 'doc' || doc_id AS chrom, length(seq)::DOUBLE AS z FROM seqs), unnest(range(5)) AS t(i) WHERE z > 0"""
    ),
)
def axis_ticks(spark, sf):
    z = _sizes(spark, sf)
    ticks = z.select("chrom", F.posexplode(tracks.axis_ticks(F.lit(0), F.col("size"), F.lit("p"))).alias("i", "t"))
    return ticks.select("chrom", F.col("i").cast("long").alias("i"), F.round("t.at", 6).alias("at"), F.col("t.text").alias("arm_text"))


@query("chroms_by_size", chain("SELECT 'doc' || doc_id AS chrom, length(seq) AS size FROM seqs WHERE length(seq) > 0"))
def chroms_by_size(spark, sf):
    return tracks.by_size(_sizes(spark, sf))


@query("category_union", chain("SELECT DISTINCT 'doc' || doc_id AS chrom FROM paths WHERE type IN ('misassembly', 'gapped_misassembly', 'discordant', 'gapped_discordant')", *ALL, PATHS))
def category_union(spark, sf):
    return tracks.category_union(scan(spark, sf, EXACT).path_summary.select(F.col("header").alias("chrom"), "type"), report.FLAGGED)


@query("all_blocks", chain("SELECT 'doc' || doc_id AS chrom, label, s, e, 'terminal' AS kind FROM blocks UNION ALL SELECT 'doc' || doc_id, 'b', s, e, 'interstitial' FROM gaps", *ALL))
def all_blocks(spark, sf):
    inner = scan(spark, sf, EXACT).gaps.select(F.col("header").alias("chrom"), F.lit("b").alias("label"), "start", "end")
    return tracks.all_blocks(_calls(spark, sf), inner).withColumnsRenamed({"start": "s", "end": "e"})


@query("bp_texts", "SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.2f Mb', n / 1e6) WHEN n >= 1000 THEN printf('%.1f kb', n / 1e3) ELSE n || ' bp' END AS text FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * 8 AS n FROM orders)")
def bp_texts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tracks.bp_short(F.floor("o_totalprice") * 8).alias("text"))


@query(
    "variant_rate",
    chain(
        "SELECT count(*) AS measured, count(*) FILTER (b.s < t.e + 200 AND t.e < b.e) AS included, round(count(*) FILTER (b.s < t.e + 200 AND t.e < b.e) / count(*), 6) AS rate FROM truth t JOIN blocks b ON chrom = 'doc' || doc_id AND label = arm AND t.s < b.e AND b.s < t.e WHERE t.s < t.e",
        *ALL,
        _TRUTH,
    ),
)
def variant_rate(spark, sf):
    t = _truth(spark, sf).withColumns({"variant_start": F.col("end"), "variant_end": F.col("end") + 200})
    return tracks.variant_rate(t, _calls(spark, sf)).withColumn("rate", F.round("rate", 6))


@query("multiset_diff", "SELECT n_regionkey AS k, 'left' AS side FROM (SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey, 'right' FROM (SELECT r_regionkey FROM region EXCEPT ALL SELECT n_regionkey FROM nation)")
def multiset_diff(spark, sf):
    return report.multiset_difference(table(spark, sf, "nation").select(F.col("n_regionkey").alias("k")), table(spark, sf, "region").select(F.col("r_regionkey").alias("k")))


@query("true_runs", "SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, sum((NOT v)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT user_id, event_id, value > 50 AS v FROM events)) WHERE v GROUP BY user_id, g")
def true_runs(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") > 50).alias("v"))
    return report.true_runs(e, ["user_id"], "event_id", "v")


@query("event_islands", "SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM (SELECT user_id, event_id, t, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600, TRUE) AS b FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t FROM events))) GROUP BY user_id, g")
def event_islands(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("t"))
    keys, order = ["user_id"], ["t", "event_id"]
    flagged = e.withColumn("b", islands.gap_above("t", keys, order, 3600))
    return islands.islands(flagged, keys, order, F.col("b")).groupBy("user_id", "island").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).drop("island")


def queries() -> dict[str, Query]:
    from . import files

    return QUERIES | files.QUERIES


_PASSING = "doc_id IN (SELECT doc_id FROM blocks)"
_CAPS = "SELECT 'doc' || doc_id AS seg, role, max(length) AS length FROM (SELECT *, CASE WHEN s <= n - e THEN 'start' ELSE 'end' END AS role FROM blocks) GROUP BY doc_id, role"
#: SQL for queries through files and streams, which give back what went in, or what the same rows give without them.
ROUND_TRIPS = {
    "fasta_round_trip": chain("SELECT header, length(seq) AS length, md5(seq) AS digest FROM seqs"),
    "fastq_round_trip": chain(f"SELECT header, md5(seq) AS digest FROM seqs WHERE {_PASSING}", _READ_CONTIGS, *_READS),
    "bam_round_trip": chain(f"SELECT md5(seq) AS digest, count(*) AS n, sum(36 + length(header) + 1 + (length(seq) + 1) // 2 + length(seq))::BIGINT AS bytes FROM seqs WHERE {_PASSING} GROUP BY 1", _READ_CONTIGS, *_READS),
    "gfa_round_trip": chain(
        f"""SELECT 'S' AS kind, 'S\ttelomere_' || seg || '+_' || role || '\t*\tLN:i:6\tRC:i:6000\tTL:i:' || length AS line FROM ({_CAPS})
UNION ALL SELECT 'L', 'L\ttelomere_' || seg || '+_' || role || '\t+\t' || seg || '\t' || CASE role WHEN 'start' THEN '+' ELSE '-' END || '\t0M\tRC:i:0' FROM ({_CAPS})""",
        _SEGMENTS,
        *_SEGMENT_BLOCKS,
    ),
    "bed_round_trip": chain(
        """SELECT 'doc' || doc_id AS chrom, s AS start, e AS "end", length, label, CASE WHEN f THEN c ELSE 0 END AS forward_count, CASE WHEN f THEN 0 ELSE c END AS reverse_count,
c AS canonical_count, 0 AS noncanonical_count, path_size, 'scaffold' AS terminality FROM blocks WHERE terminal""",
        *(x.replace("e - s AS length, c,", "e - s AS length, c, f,") for x in ALL),
    ),
    "stream_read_filter": chain(f"SELECT doc_id AS idx, length(seq) AS length FROM seqs WHERE {_PASSING}", _READ_CONTIGS, *_READS),
    "stream_sessions": """SELECT user_id, min(t) AS first, max(t) + 3600000000 AS until, count(*) AS n FROM (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g
FROM (SELECT user_id, event_id, t, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600000000, TRUE) AS b FROM (SELECT user_id, event_id, epoch_us(ts) AS t FROM events))) GROUP BY user_id, g""",
}


def oracle_sql() -> dict[str, str]:
    return SQL | ROUND_TRIPS
