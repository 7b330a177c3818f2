"""Choice of records by id and prefix; excludes win."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SelectionError(ValueError):
    """Records or selectors that don't fit each other."""


def prefix_match(name: Column, prefixes) -> Column:
    """Prefixes are an option, hence few: one predicate that scans can evaluate."""
    return reduce(lambda a, b: a | b, (name.startswith(p) for p in prefixes), F.lit(False))


def select(records: DataFrame, name: str = "header", includes: DataFrame | None = None, include_prefixes=(), excludes: DataFrame | None = None, exclude_prefixes=()) -> DataFrame:
    """Records whose name is among ``includes`` (column ``id``) or starts with an include prefix, if there is either,
    less those that the same for excludes names.  Both id tables join; how is left to their size."""
    out = records
    if includes is not None or include_prefixes:
        hit = prefix_match(F.col(name), include_prefixes)
        if includes is not None:
            ids = includes.select(F.col("id").alias("_in")).distinct()
            out = out.join(ids, F.col(name) == F.col("_in"), "left").where(F.col("_in").isNotNull() | hit).drop("_in")
        else:
            out = out.where(hit)
    if excludes is not None:
        out = out.join(excludes.select(F.col("id").alias("_out")).distinct(), F.col(name) == F.col("_out"), "left_anti")
    if exclude_prefixes:
        out = out.where(~prefix_match(F.col(name), exclude_prefixes))
    return out


def unmatched_ids(selectors: DataFrame, records: DataFrame, name: str = "header") -> DataFrame:
    return selectors.select("id").distinct().join(records.select(F.col(name).alias("id")), "id", "left_anti")


def unmatched_prefixes(prefixes: DataFrame, records: DataFrame, name: str = "header") -> DataFrame:
    """Prefixes (column ``prefix``, few) that no record starts with.

    Records are cut to the lengths that prefixes have, so this is an equi-join."""
    lengths = prefixes.select(F.length("prefix").alias("n")).distinct()
    heads = records.select(name).join(lengths, F.length(name) >= F.col("n")).select(F.substr(name, F.lit(1), F.col("n")).alias("prefix")).distinct()
    return prefixes.select("prefix").distinct().join(heads, "prefix", "left_anti")


def duplicate_ids(records: DataFrame, name: str = "header") -> DataFrame:
    return records.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def checked(records: DataFrame, name: str = "header", selectors: DataFrame | None = None, shown: int = 10) -> DataFrame:
    """The records, once it is known that names are unique and that every selector names one; else an error that shows
    the first few in order."""
    for found, column, what in ((duplicate_ids(records, name), name, "duplicate ids"), *([(unmatched_ids(selectors, records, name), "id", "selectors without a record")] if selectors is not None else [])):
        first = [r[0] for r in found.orderBy(column).limit(shown).collect()]
        if first:
            more = found.count() - len(first)
            raise SelectionError(f"{what}: {', '.join(map(str, first))}" + (f" and {more} more" if more else ""))
    return records
