"""Sequences derived from tables without any, the same in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACG"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_pos, header, seq``: a sequence for each document, of its whole text.

    Letters become bases, all else N (in every third document) or A; repeats of varying length stand at both ends, the
    wrong way round in some.  A letter is one base, also the dotted capital I, which Spark's lower() makes two letters of."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.regexp_replace(F.translate(F.lower(F.replace("text", F.lit("\u0130"), F.lit("i"))), _LETTERS, _BASES), F.lit("[^ACGT]"), F.when(F.col("doc_id") % 3 == 0, "N").otherwise("A"))
    p, q = F.repeat(F.lit("CCCTAA"), (F.col("doc_id") % 5 * 30).cast("int")), F.repeat(F.lit("TTAGGG"), (F.col("doc_id") % 7 * 20).cast("int"))
    seq = F.when(F.col("doc_id") % 11 == 5, F.concat(q, body, p)).otherwise(F.concat(p, body, q))
    return d.select(F.col("doc_id").alias("seq_pos"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("header"), seq.alias("seq"))


SEQUENCES = f"""
body AS (SELECT doc_id, regexp_replace(translate(lower(text), '{_LETTERS}', '{_BASES}'), '[^ACGT]', CASE WHEN doc_id % 3 = 0 THEN 'N' ELSE 'A' END, 'g') AS b,
                repeat('CCCTAA', (doc_id % 5 * 30)::INT) AS p, repeat('TTAGGG', (doc_id % 7 * 20)::INT) AS q FROM documents),
seqs AS (SELECT doc_id, 'doc' || doc_id AS header, CASE WHEN doc_id % 11 = 5 THEN q || b || p ELSE p || b || q END AS seq FROM body)"""

PARTS = """
cut AS (SELECT doc_id, length(seq) AS path_size, regexp_split_to_array(seq, 'N+') AS bs, regexp_extract_all(seq, 'N+') AS gs FROM seqs),
flat AS (SELECT doc_id, path_size, unnest(range(len(bs))) AS idx, unnest(bs) AS bases, unnest(list_concat(gs, [''])) AS gap FROM cut),
placed AS (SELECT *, coalesce(sum(length(bases) + length(gap)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM flat),
contigs AS (SELECT doc_id, path_size, idx AS contig_no, st AS contig_start, length(bases) AS n, bases FROM placed WHERE length(bases) > 0),
gaps AS (SELECT doc_id, st + length(bases) AS s, st + length(bases) + length(gap) AS e FROM placed WHERE length(gap) > 0)"""


def hits(condition: str) -> str:
    """Exact matches: neither motif overlaps itself, so the pieces between them tell where they are."""
    return f"""
split AS (SELECT doc_id, path_size, contig_no, contig_start, n, f, string_split(bases, m) AS ps FROM contigs, (VALUES ('CCCTAA', TRUE), ('TTAGGG', FALSE)) AS v(m, f)),
pieces AS (SELECT * EXCLUDE ps, len(ps) AS k, unnest(range(len(ps))) AS i, unnest(ps) AS piece FROM split),
every_hit AS (SELECT * EXCLUDE piece, (sum(length(piece)) OVER (PARTITION BY doc_id, contig_no, f ORDER BY i) + 6 * i)::BIGINT AS pos FROM pieces),
hits AS (SELECT doc_id, path_size, contig_no, contig_start, n, f, pos FROM every_hit WHERE i < k - 1 AND ({condition}))"""


def blocks(limit: int, shortest: int) -> str:
    """Terminal blocks of exact matches at distances 50 and 500, density one half."""
    return f"""
brk AS (SELECT *, pos - lag(pos) OVER w > 50 AS b FROM hits WINDOW w AS (PARTITION BY doc_id, contig_no, f ORDER BY pos)),
numbered AS (SELECT *, sum(coalesce(b, TRUE)::INT) OVER (PARTITION BY doc_id, contig_no, f ORDER BY pos) AS island FROM brk),
islands AS (SELECT doc_id, path_size, contig_no, contig_start, n, f, island, min(pos) AS s, max(pos) AS last_pos, max(pos) + 6 AS e, count(*) AS c FROM numbered GROUP BY ALL),
good AS (SELECT * FROM islands WHERE (n <= {limit} OR CASE WHEN f THEN s < {limit} ELSE last_pos >= n - {limit} END) AND c >= 2 AND 2 * 6 * c >= e - s),
brk2 AS (SELECT *, s - lag(e) OVER w AS g FROM good WINDOW w AS (PARTITION BY doc_id, contig_no, f ORDER BY s)),
numbered2 AS (SELECT *, sum((g IS NULL OR g < 0 OR g > 500)::INT) OVER (PARTITION BY doc_id, contig_no, f ORDER BY s) AS hull FROM brk2),
hulls AS (SELECT doc_id, path_size, contig_no, contig_start, n, f, hull, min(s) AS s, max(e) AS e, sum(c)::BIGINT AS c FROM numbered2 GROUP BY ALL),
blocks AS (SELECT doc_id, path_size, contig_no, contig_start, n, CASE WHEN f THEN 'p' ELSE 'q' END AS label, contig_start + s AS s, contig_start + e AS e, e - s AS length, c,
                  CASE WHEN f THEN s <= n - e ELSE s >= n - e END AS valid,
                  contig_start + s < {limit} OR contig_start + e > greatest(path_size - {limit}, 0) AS terminal FROM hulls WHERE e - s >= {shortest})"""


PATHS = """
ranked AS (SELECT *, terminal AND row_number() OVER (PARTITION BY doc_id, label, terminal ORDER BY c DESC, s) = 1 AS longest FROM blocks),
per_path AS (SELECT doc_id, string_agg(CASE WHEN longest THEN upper(label) ELSE label END || CASE WHEN valid THEN '' ELSE '*' END, '' ORDER BY s, label) AS granular,
                    string_agg(label, '' ORDER BY s, label) FILTER (longest) AS labels, count(*) FILTER (longest) AS telomeres, bool_or(longest AND NOT valid) AS wrong,
                    min(s) FILTER (longest AND label = 'p') AS ps, min(s) FILTER (longest AND label = 'q') AS qs,
                    bool_or(terminal AND NOT longest AND valid AND label = 'p') AS more_p, bool_or(terminal AND NOT longest AND valid AND label = 'q') AS more_q FROM ranked GROUP BY doc_id),
gap_counts AS (SELECT doc_id, count(*) AS gaps FROM gaps GROUP BY doc_id),
paths AS (SELECT seqs.doc_id, header, length(seq) AS path_size, coalesce(telomeres, 0) AS telomeres, coalesce(labels, 'none') AS labels, coalesce(gaps, 0) AS gaps,
                 CASE WHEN gaps > 0 THEN 'gapped_' ELSE '' END || CASE WHEN wrong THEN 'discordant' WHEN ps < qs THEN 't2t' WHEN ps >= qs THEN 'misassembly'
                   WHEN (ps IS NOT NULL AND more_p) OR (qs IS NOT NULL AND more_q) THEN 'misassembly' WHEN ps IS NULL AND qs IS NULL THEN 'none' ELSE 'incomplete' END AS type,
                 coalesce(granular, '') AS granular FROM seqs LEFT JOIN per_path USING (doc_id) LEFT JOIN gap_counts USING (doc_id))"""
