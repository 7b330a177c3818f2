"""Scalar functions on sequences and numbers, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def base_count(seq: Column, bases: str) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, bases, ""))).cast("long")


def gc_percent(c: Column, g: Column, size: Column) -> Column:
    return F.when(size > 0, (c + g) * 100.0 / size)


def entropy(counts: list[Column], size: Column) -> Column:
    """Shannon entropy in bits over the four bases, to three places, halves away from zero."""
    terms = [F.when(n > 0, n / size * F.log2(n / size)).otherwise(0.0) for n in counts]
    return F.round(-(terms[0] + terms[1] + terms[2] + terms[3]), 3) + 0.0


def hamming(a: Column, b: Column) -> Column:
    """Places where two strings of one length differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def strand_label(forward: Column, count: Column) -> Column:
    """p above 66.6 % forward, q below 33.3 %, else b; in single precision."""
    share = (forward * F.lit(100.0) / count).cast("float")
    return F.when(share > F.lit(66.6).cast("float"), "p").when(share < F.lit(33.3).cast("float"), "q").otherwise("b")


def ratio(part: Column, rest: Column) -> Column:
    """part of part + rest; -1 without either."""
    return F.when(part + rest > 0, part / (part + rest)).otherwise(-1.0)


def strand_bias(strand_ratio: Column) -> Column:
    return F.when(strand_ratio >= 0, F.abs(2 * strand_ratio - 1)).otherwise(strand_ratio)


def end_distance(label: Column, start: Column, end: Column, size: Column) -> Column:
    """How far a block lies from the end it belongs to; either for b."""
    return F.when(label == "p", start).when(label == "q", F.greatest(size - end, F.lit(0))).otherwise(F.least(start, F.greatest(size - end, F.lit(0))))


def primary_id(header: Column) -> Column:
    return F.regexp_extract(header, r"^[^ \t\r\n\f\x0b]*", 0)


def strict_unsigned(text: Column) -> Column:
    """Digits only, within 64 bits; null otherwise."""
    n = F.when(text.rlike("^0*[0-9]{1,20}$"), F.regexp_replace(text, "^0+(?=[0-9])", "")).try_cast("decimal(20,0)")
    return F.when(n <= F.lit("18446744073709551615").cast("decimal(20,0)"), n)


def filename_safe(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def bp_text(n: Column) -> Column:
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" bp"))).otherwise(F.concat(F.format_string("%.1f", n / 1000.0), F.lit(" kbp")))


def general(x: float, digits: int = 6) -> str:
    """A number as C++ streams print it."""
    return f"{x:.{digits}g}"


def region(text: str) -> tuple[str, int | None, int | None]:
    """``name``, ``name:start-end``; coordinates may have commas and end in kb, mb or kbp, mbp."""
    name, colon, rest = text.rpartition(":")
    if not colon or "-" not in rest:
        return text, None, None

    def number(x: str) -> int:
        x = x.strip().lower().replace(",", "").removesuffix("p")
        for unit, times in (("kb", 1_000), ("mb", 1_000_000), ("b", 1)):
            if x.endswith(unit):
                return round(float(x.removesuffix(unit)) * times)
        return round(float(x))

    a, _, b = rest.partition("-")
    return name, number(a), number(b)
