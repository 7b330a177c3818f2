"""Assembly graphs: GFA 1 (H, S, L, J, P lines), and the segment lines of GFA 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fasta import FormatError
from .files import numbered


def gfa_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, kind, fields, line``, blank lines and comments left out."""
    raw = numbered(spark.read.text(path), "line_no").select("line_no", F.regexp_replace("value", "\r$", "").alias("line"))
    fields = F.split("line", "\t", -1)
    return raw.where("line <> '' and not startswith(line, '#')").select("line_no", F.substring("line", 1, 1).alias("kind"), fields.alias("fields"), "line")


def segments(lines: DataFrame) -> DataFrame:
    """``line_no, segment, seq``; ``*`` is null.  A numeric third field is a GFA 2 length."""
    f = F.col("fields")
    second = F.get(f, F.lit(2)).rlike("^[0-9]+$") & F.get(f, F.lit(3)).isNotNull()
    seq = F.when(second, F.get(f, F.lit(3))).otherwise(F.get(f, F.lit(2)))
    return lines.where("kind = 'S'").select("line_no", F.get(f, F.lit(1)).alias("segment"), F.when(seq != "*", seq).alias("seq"))


def links(lines: DataFrame, kind: str = "L") -> DataFrame:
    f = F.col("fields")
    return lines.where(F.col("kind") == kind).select("line_no", *(F.get(f, F.lit(i + 1)).alias(n) for i, n in enumerate(("a", "a_orient", "b", "b_orient", "value"))))


def paths(lines: DataFrame) -> DataFrame:
    """``path_id, idx, kind, ref_id, orient`` of the steps of each path; a ``;`` before a step is a jump."""
    f = F.col("fields")
    steps = lines.where("kind = 'P'").select(F.get(f, F.lit(1)).alias("path_id"), F.posexplode(F.split(F.get(f, F.lit(2)), "[,;]")).alias("idx", "step"))
    orient = F.regexp_extract("step", "([+-])$", 1)
    return steps.select("path_id", "idx", F.lit("S").alias("kind"), F.regexp_replace("step", "[+-]$", "").alias("ref_id"), F.when(orient != "", orient).otherwise("0").alias("orient"))


def tags(lines: DataFrame, first: int = 3) -> DataFrame:
    """``line_no, tags``: map of tag to type and value."""
    t = F.transform(F.filter(F.slice("fields", first + 1, 1 << 20), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")), lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.struct(F.substring(x, 4, 1).alias("type"), F.regexp_replace(x, "^.{5}", "").alias("value")).alias("value")))
    return lines.select("line_no", F.map_from_entries(t).alias("tags"))


def checked(lines: DataFrame) -> DataFrame:
    """The lines, once none is of GFA 2, of another kind, or short of fields; else a FormatError with the first."""
    need = F.create_map(*(F.lit(x) for kv in (("H", 1), ("S", 3), ("L", 6), ("J", 6), ("P", 4)) for x in kv))
    short = F.size("fields") < F.element_at(need, F.col("kind"))
    what = F.when(F.get("fields", F.lit(1)).startswith("VN:Z:2"), "GFA 2 can't be filtered").when(~F.col("kind").isin("H", "S", "L", "J", "P"), "unknown record").when(short, "too few fields").when((F.col("kind") == "S") & F.get("fields", F.lit(2)).rlike("^[0-9]+$"), "segment with a length")
    bad = lines.withColumn("what", what).where("what is not null").agg(F.min(F.struct("line_no", "what", "line")).alias("x")).first()["x"]
    if bad:
        raise FormatError(f"line {bad['line_no'] + 1}: {bad['what']}: {bad['line'][:80]}")
    return lines


def annotated(lines: DataFrame, cap_lines: DataFrame) -> DataFrame:
    """``seq_pos, line``: the lines as they are, then those of caps, segments before links.

    What is written is GFA 1: a header of version 2 becomes 1.2, and segments lose the length before their bases."""
    second = (F.col("kind") == "S") & F.get("fields", F.lit(2)).rlike("^[0-9]+$") & F.get("fields", F.lit(3)).isNotNull()
    shorter = F.concat_ws("\t", F.slice("fields", 1, 2), F.slice("fields", 4, F.greatest(F.size("fields") - 3, F.lit(0))))
    line = F.when(F.col("kind") == "H", F.regexp_replace("line", r"\tVN:Z:2[^\t]*", "\tVN:Z:1.2")).when(second, shorter).otherwise(F.col("line"))
    old = lines.select(F.struct(F.lit(0).alias("rank"), F.col("line_no").alias("n"), F.lit("").alias("node")).alias("seq_pos"), line.alias("line"))
    new = cap_lines.select(F.struct(F.col("rank"), F.lit(0).cast("long").alias("n"), F.col("node")).alias("seq_pos"), "line")
    return old.unionByName(new)


def colors(caps: DataFrame) -> DataFrame:
    return caps.select("node").distinct().select(F.col("node").alias("seq_pos"), F.concat("node", F.lit("\t#008000")).alias("line"))
