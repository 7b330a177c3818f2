"""Secret scans with multipart credential linking, with DataFrame expressions only.

Spans come from Java's regular expressions: the pieces between matches and the matches themselves, whose lengths sum up
to offsets in code points.  Strong kinds count wherever they are.  Weak kinds (a named identifier, a mixed token, an
endpoint) count only where a complementary part lies within the scope: an interval join of candidates on the document
and on stretches of SCOPE characters, whose size bounds what can meet in one place."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Code points between two parts of one credential, at most.
SCOPE = 200
#: Kind, pattern, what it is a part of.  The first three are strong; letters of names in either case.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = (
    ("assign", ASSIGN, "secret"),
    ("access", r"AKIA[A-Z0-9]{16,}", "identifier"),
    ("hex", r"[0-9a-f]{24,}", "secret"),
    ("name", r"(?i)(?:access_?key_?id|client_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}", "identifier"),
    ("mixed", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}", "secret"),
    ("endpoint", r"(?i)(?:https?|wss?|ftps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|s3)://[^\s\"'<>]+", "endpoint"),
)
STRONG = 3
#: What a match of ``mixed`` must hold, anywhere in it.
MIXED = ("[0-9]", "[a-z]", "[A-Z]")
#: What a weak part needs in its scope.
NEEDS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
SPANS = "array<struct<start:int,kind:int,end:int,counts:boolean>>"
#: A text without any of these has no candidate.
ANY = r"(?i:passw|secret|token|api_?key|_?key_?id|client_?id|user_?name|login|://)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{32}"


def _spans(kind: int, pattern: str) -> Column:
    """Array of (start, kind, end, size of group 2), leftmost matches that don't overlap.

    Matching longer runs only ({16,}, {24,}) gives what matching all runs and dropping the short ones gives, as such a
    run has one maximal extent; ``assign`` and ``mixed`` are matched whole and filtered, as a dropped match still takes
    its text."""
    text, name = F.col("text"), KINDS[kind][0]
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if name == "assign":
        counts = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x) >= 6)
    else:
        counts = F.transform(found, lambda x: reduce(and_, (x.rlike(p) for p in MIXED)) if name == "mixed" else F.lit(True))
    both = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), counts.alias("counts"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        s = state["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        span = F.struct(s.alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x["counts"].alias("counts"))
        return F.struct(e.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.filter(F.aggregate(both, start, step, lambda s: s["spans"]), lambda x: x["counts"])


def candidates(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``row, doc_id, spans, kept`` of each row: all candidates of all kinds, and a struct of the columns ``keep``, whose
    names clash with nothing in there.  Texts that can hold none are looked at once."""
    none = F.expr(f"cast(array() as {SPANS})")
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("boolean")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), kept.alias("kept"))
    found = F.when(F.col("text").rlike(ANY), F.concat(*(_spans(k, p) for k, (_, p, _) in enumerate(KINDS)))).otherwise(none)
    return base.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("spans"), "kept")


def linked(found: DataFrame) -> DataFrame:
    """``row, linked``: the weak spans of each row that a complementary part supports."""
    part = F.element_at(F.array(*(F.lit(p) for _, _, p in KINDS)), F.col("kind") + 1)
    flat = found.where(F.exists("spans", lambda x: x["kind"] >= STRONG)).select("row", F.explode("spans").alias("x")).select("row", "x.start", "x.kind", "x.end").withColumn("part", part)
    wants = F.element_at(F.create_map(*(y for k, v in NEEDS.items() for y in (F.lit(k), F.array(*map(F.lit, v))))), F.col("part"))
    cells = lambda lo, hi: F.explode(F.sequence((lo / SCOPE).cast("int"), (hi / SCOPE).cast("int")))
    weak = flat.where(F.col("kind") >= STRONG).withColumn("part", F.explode(wants)).withColumn("cell", cells(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE))
    other = flat.select("row", "part", F.col("start").alias("s"), F.col("end").alias("e"), F.col("kind").alias("k")).withColumn("cell", cells(F.col("s"), F.col("e")))
    near = (F.col("s") <= F.col("end") + SCOPE) & (F.col("start") <= F.col("e") + SCOPE)
    # a token that a strong span covers is that span, not a part beside it
    apart = (F.col("s") >= F.col("end")) | (F.col("start") >= F.col("e"))
    joined = weak.join(other, ["row", "part", "cell"]).where(near & apart).select("row", "start", "kind", "end").distinct()
    return joined.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def scan(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, base, linked, kept``: arrays of (start, kind, end) in order of start, then kind; the columns ``keep``.

    Null text is empty and has no spans; offsets are code points, ends exclusive.  Rows without an id and repeated rows
    are scanned like any other.  An empty table gives an empty table."""
    found, _ = stored(candidates(documents, keep), "secrets")
    base = F.array_sort(F.transform(F.filter("spans", lambda x: x["kind"] < STRONG), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return found.join(linked(found), "row", "left").select("doc_id", base.alias("base"), F.coalesce(F.array_sort("linked"), none).alias("linked"), "kept")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k, _, _ in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each row; see ``scan``."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return scan(documents).select("doc_id", *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(STRONG)), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "linked"))).alias("spans"))


def redacted(documents: DataFrame, by: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``documents``, each span (of overlapping ones their hull) in ``text`` replaced.

    ``n_chars``, where there is one, counts what is left.  Nothing else changes; null text stays null."""
    columns, text = documents.columns, F.col("kept.text")
    found = scan(documents, tuple(columns))
    spans = F.array_sort(F.concat("base", "linked"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        fresh = x["start"] >= state["at"]
        piece = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit(by))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), piece.alias("out"))

    end = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    out = found.withColumn("clean", F.when((F.size(spans) > 0) & text.isNotNull(), F.aggregate(spans, begin, step, end)).otherwise(text))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNotNull(), F.length("clean").cast("long"))}
    return out.select(*((new[c] if c in new else F.col(f"kept.`{c}`")).alias(c) for c in columns))
