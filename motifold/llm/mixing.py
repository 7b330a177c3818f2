"""Mixing sources to target weights by entropy balancing, with DataFrame expressions only.

Among all document rates w that meet ``sum(size * w) = target`` for each constraint, the ones nearest to 1 in relative
entropy (each word counts) are exponentially tilted: ``w = exp(sum of lambda over a document's constraints)``.  Newton's
method minimises the convex dual ``sum(size * w) - sum(lambda * target)``: each step is an aggregate over the documents'
rates (those of equal constraints taken together, once) that gives the gradient ``sum(size * w) - target`` and the
Hessian ``sum(size * w)`` over pairs of constraints, then a step by their quotient, until the gradient vanishes.

Constraints of one family, as the sources, are disjoint, and their Hessian is diagonal: each step is a column expression
on the table of constraints, however long that is.  Families that overlap, as sources and languages, are solved jointly.

Rates are then rounded into copies: every document is taken ``floor(w)`` times, and once more along an order drawn from
a hash of the id until the source's target is met; of the copy that crosses the target only the words up to it count.
The running sum along that order is taken in ranges of the hash, as many as keep a range small, so no task holds a source
whole."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, stored

#: Newton steps at most; a step moves lambda by REACH at most; the largest part of a target that may be amiss in the end.
STEPS, REACH, AMISS = 60, 2.0, 1e-10
#: Constraints that overlapping families may have between them: their Hessian is solved on the driver.
JOINT = 1000
#: Documents of a range of the order, about.
RANGE = 100_000
#: A document is taken at most so often.
MOST = 3
WEIGHTS = (1, 2, 3)


def n_words(text: str) -> Column:
    """Words of a text: runs of other characters than space, tab, line feed, vertical tab, form feed, return."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def ranked(sums: DataFrame) -> DataFrame:
    """Adds ``at``: the place of each source by code point, null last, from 0.  No task sorts all sources."""
    order = F.col("source").asc_nulls_last()
    placed, _ = stored(sums.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    at = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return placed.withColumn("at", at).join(F.broadcast(before), "part").withColumn("at", F.col("at") + F.col("before")).drop("part", "before")


def source_targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` of each source: a share of all words by weight, held at most * source_size.

    Weights go 1, 2, 3, 1, ... by source in code-point order, null last.  What is above a source's limit is shared
    again by weight: the level of words a weight rises until no further source is held at its limit."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*map(F.lit, WEIGHTS))
    t = ranked(sums).withColumn("weight", F.element_at(weights, (F.col("at") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    t, _ = stored(t.select("source", "source_size", "weight", (F.col("source_size") * most).cast("double").alias("limit")), "weights")
    total, heavy = t.agg(F.sum("source_size"), F.sum("weight")).first()
    level, held = (total or 0) / (heavy or 1), None
    while True:
        full = F.col("limit") / F.col("weight") <= level
        n, limits, rest = t.agg(F.count_if(full), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == held or not rest:
            break
        level, held = (total - (limits or 0.0)) / rest, n
    return t.select("source", "source_size", F.when(F.col("limit") / F.col("weight") <= level, F.col("limit")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _step(target: Column, now: Column) -> Column:
    """Newton's step of a lambda: the gradient over the Hessian's diagonal, within REACH."""
    return F.greatest(F.lit(-REACH), F.least(F.lit(REACH), (target - now) / now))


def tilted(cells: DataFrame, targets: DataFrame, family: str) -> DataFrame:
    """``targets`` (``family``, ``target``) with ``rate``: exp of the dual's solution.

    ``cells`` has ``family`` and ``mass``, the words of documents of equal constraints.  Constraints without words or
    with a target of 0 have rate 0."""
    now, at = stored(targets.withColumn("lam", F.lit(0.0)), "lambda")
    for _ in range(STEPS):
        of = now.select(F.col(family).alias("of"), "lam")
        rates = cells.join(of, F.col(family).eqNullSafe(F.col("of"))).groupBy(F.col("of").alias("g")).agg(F.sum(F.col("mass") * F.exp("lam")).alias("now"))
        held = now.join(rates, F.col(family).eqNullSafe(F.col("g")), "left").drop("g")
        open_ = (F.col("target") > 0) & (F.col("now") > 0)
        after, to = stored(held.select(*targets.columns, F.when(open_, F.col("lam") + _step(F.col("target"), F.col("now"))).otherwise(F.col("lam")).alias("lam"), F.when(open_, F.abs(F.col("now") - F.col("target")) / F.col("target")).alias("amiss"), F.coalesce(open_, F.lit(False)).alias("open")), "lambda")
        worst = after.agg(F.max("amiss")).first()[0]
        discard(targets.sparkSession, at)
        now, at = after.drop("amiss", "open"), to
        if worst is None or worst <= AMISS:
            break
    return after.select(*targets.columns, F.when(F.col("open"), F.exp("lam")).otherwise(0.0).alias("rate"))


def jointly_tilted(cells: DataFrame, targets: dict[str, dict]) -> DataFrame:
    """``cells`` with ``rate`` for overlapping families of constraints: ``targets`` has the words of each value by family.

    ``cells`` has a column for each family and ``mass``; values without a target are not constrained.  A step's gradient
    and Hessian are aggregates over the cells; the system, of JOINT constraints at most, is solved on the driver.  Where
    no rates meet all targets, the last step's are given."""
    places = {}
    for f, wanted in targets.items():
        places |= {(f, v): len(places) + i for i, v in enumerate(wanted)}
    if len(places) > JOINT:
        raise ValueError(f"{len(places)} constraints in overlapping families; at most {JOINT} can be solved together")
    want = np.array([float(targets[f][v]) for f, v in places])
    lam = np.zeros(len(places))
    place = {f: F.coalesce(*(F.when(F.col(f).eqNullSafe(F.lit(v)), F.lit(i)) for (g, v), i in places.items() if g == f)) for f in targets}
    known = cells.select("*", F.array_compact(F.array(*place.values())).alias("of"))

    def rated(lam: np.ndarray) -> DataFrame:
        each = F.array(*(F.lit(float(x)) for x in lam))
        return known.withColumn("rate", F.exp(F.aggregate("of", F.lit(0.0), lambda s, i: s + F.element_at(each, i + 1))))

    for _ in range(STEPS):
        pairs = rated(lam).select(F.explode("of").alias("i"), "of", (F.col("mass") * F.col("rate")).alias("x")).select("i", F.explode("of").alias("j"), "x")
        h = np.zeros((len(lam), len(lam)))
        for i, j, x in pairs.groupBy("i", "j").agg(F.sum("x")).collect():  # at most JOINT * JOINT
            h[i, j] = x
        gradient = np.diag(h) - want
        if np.all(np.abs(gradient) <= AMISS * np.maximum(want, 1)):
            break
        step = np.linalg.lstsq(h + np.eye(len(lam)) * 1e-12 * max(1.0, np.trace(h)), gradient, rcond=None)[0]
        lam = lam - step * min(1.0, REACH / max(1e-300, float(np.abs(step).max())))
    return rated(lam).drop("of")


def order_key() -> Column:
    """Where a document stands in its source's order; without an id its text says."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))


def mixed(documents: DataFrame, keep: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of each row of ``documents``, and its columns ``keep``.

    ``taken`` is the words that the mix takes, repeats counted; ``copies`` the copies they lie in.  Null text has size 0
    and is never taken; a null source is a source of its own; repeated ids (and equal texts without an id) share a place
    in the order, where size and then chance (which doesn't show) decide.  Reruns agree.  An empty table gives an empty
    table."""
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("boolean")
    sized, _ = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"), order_key().alias("o"), kept.alias("kept")), "sizes")
    targets = source_targets(sized, most)
    cells = targets.select("source", F.col("source_size").cast("double").alias("mass"))  # a source's documents have equal constraints
    known = tilted(cells, targets, "source")
    whole = F.least(F.floor(F.col("rate") + 1e-6), F.lit(most)).cast("long")
    known = known.withColumn("whole", whole).withColumn("more", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    digits = max(2, math.ceil(math.log(max(1, sized.count() / RANGE), 16)))
    sized = sized.withColumn("range", F.substring("o", 1, digits))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    # ranges of ranges, so that running sums over them aren't one task's either
    coarse = ranges.groupBy("source", F.substring("range", 1, digits - digits // 2).alias("wide")).agg(F.sum("in_range").alias("in_wide"))
    coarse = coarse.withColumn("first", F.sum("in_wide").over(Window.partitionBy("source").orderBy("wide")) - F.col("in_wide")).select(F.col("source").alias("s"), "wide", "first")
    ranges = ranges.withColumn("w", F.substring("range", 1, digits - digits // 2))
    ranges = ranges.withColumn("offset", F.sum("in_range").over(Window.partitionBy("source", "w").orderBy("range")) - F.col("in_range"))
    ranges = ranges.join(coarse, F.col("source").eqNullSafe(F.col("s")) & (F.col("w") == F.col("wide"))).withColumn("offset", F.col("offset") + F.col("first")).select("source", "range", "offset")
    ranges = ranges.alias("r").join(known.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source"))).select(F.col("r.source").alias("of"), F.col("range").alias("in"), "offset", "source_size", "target", "whole", "more")
    along = Window.partitionBy("source", "range").orderBy("o", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("before", F.coalesce(F.sum("size").over(along), F.lit(0)))
    out = out.join(ranges, out["source"].eqNullSafe(ranges["of"]) & (out["range"] == ranges["in"]))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - F.col("offset") - F.col("before")))
    taken = (F.col("whole") * F.col("size") + extra).cast("long")
    copies = F.when(F.col("size") > 0, F.col("whole") + (extra > 0).cast("long")).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), copies.cast("long").alias("copies"), *(F.col(f"kept.`{k}`").alias(k) for k in keep if k != "doc_id"))


#: The same rows from DuckDB.
SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, text, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
             (source_size * 3)::DOUBLE AS lim, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
b AS (SELECT *, total - coalesce(sum(lim) OVER p, 0) AS remains, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS heavy
      FROM w WINDOW p AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, lim / weight <= remains / heavy AS is_full FROM b),
l AS (SELECT *, (total - sum(CASE WHEN is_full THEN lim ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0) AS lev FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN lim ELSE coalesce(lev * weight, 0) END AS target FROM l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-6), 3) ELSE 0 END::BIGINT AS whole FROM t),
m AS (SELECT *, greatest(0, round(target)::BIGINT - whole * source_size) AS more FROM k),
x AS (SELECT d.doc_id, d.size, m.source_size, m.target, m.whole,
             greatest(0, least(d.size, m.more - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS extra
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target, (whole * size + extra)::BIGINT AS taken,
       (CASE WHEN size > 0 THEN whole + (extra > 0)::INT ELSE 0 END)::BIGINT AS copies FROM x
"""
