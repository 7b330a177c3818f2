"""Synthetic chromosomes with known arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _base(seed: int, *keys: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, "ACGT")), (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(4)) + 1).cast("int"))


def chromosomes(spark: SparkSession, n: int, repeats: int = 2000, variants: int = 100, inner: int = 25_000, rate: float = 0.0, seed: int = 42, motif: str = "CCCTAA") -> DataFrame:
    """``seq_pos, header, seq`` and the truth ``p_end, q_start``: repeats, repeats with a changed base, random bases, and the
    same mirrored; then each base changes with probability ``rate``.  Values come from hashes of (seed, id, place)."""
    rc = motif.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    k = len(motif)

    def changed(m: str, side: int) -> Column:
        at = (F.pmod(F.xxhash64(F.lit(seed), F.lit(side), F.col("id"), F.col("i")), F.lit(k)) + 1).cast("int")
        return F.concat(F.substr(F.lit(m), F.lit(1), at - 1), _base(seed + side, F.col("id"), F.col("i")), F.substr(F.lit(m), at + 1, F.lit(k)))

    rows = spark.range(n)
    base = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(max(variants, 1) - 1))).alias("i")).where(F.lit(variants > 0))
    left = base.select("id", F.lit(2).alias("part"), "i", changed(motif, 1).alias("s"))
    right = base.select("id", F.lit(4).alias("part"), "i", changed(rc, 2).alias("s"))
    middle = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(max(inner, 1) - 1))).alias("i")).where(F.lit(inner > 0)).select("id", F.lit(3).alias("part"), "i", _base(seed + 3, F.col("id"), F.col("i")).alias("s"))
    ends = rows.select("id", F.lit(1).alias("part"), F.lit(0).alias("i"), F.lit(motif * repeats).alias("s")).union(rows.select("id", F.lit(5), F.lit(0), F.lit(rc * repeats)))
    whole = ends.unionByName(left).unionByName(right).unionByName(middle).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "i", "s"))), lambda x: x["s"]), "").alias("seq"))
    if rate > 0:
        draw = lambda i: F.pmod(F.xxhash64(F.lit(seed + 4), F.col("id"), i), F.lit(1_000_000)) < int(rate * 1_000_000)
        mutated = F.transform(F.split("seq", ""), lambda c, i: F.when(draw(i), _base(seed + 5, F.col("id"), i)).otherwise(c))
        whole = whole.withColumn("seq", F.array_join(mutated, ""))
    size = F.length("seq").cast("long")
    return whole.select(F.col("id").alias("seq_pos"), F.concat(F.lit("sim"), F.col("id").cast("string")).alias("header"), "seq", F.lit(repeats * k).cast("long").alias("p_end"), (size - repeats * k).alias("q_start"))


def truth(simulated: DataFrame) -> DataFrame:
    """``chrom, arm, start, end`` of both arms."""
    arms = F.array(F.struct(F.lit("p").alias("arm"), F.lit(0).cast("long").alias("start"), F.col("p_end").alias("end")), F.struct(F.lit("q").alias("arm"), F.col("q_start").alias("start"), F.length("seq").cast("long").alias("end")))
    return simulated.select(F.col("header").alias("chrom"), F.explode(arms).alias("x")).select("chrom", "x.*")
