"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Exact for every pair of different shingle sets, in four steps that each follow the input in size:

1. *Profile*.  One pass over the texts gives each document's set size, a 128-bit signature of its set and a few
   min-hashes.  Documents of equal signature are one class; its smallest id stands for it from here on.  The same pass
   counts shingles that repeat within a block of texts: a bounded list of the commonest, used to order n-grams.
2. *Collapse*.  A class whose min-hashes agree with those of a group's first class is compared with it exactly.  What
   links forms components.  Within such a group, whole sets of different components are then multiplied in tiles, so
   that a group of thousands of near copies needs no further look at its pairs.
3. *Product*.  The columns (n-grams) of each row are ordered, common ones last, and only a row's first
   ``n - ceil(t n) + 1`` columns are kept: two sets of similarity t must meet in them, whatever the order.  Columns are
   dealt into blocks, long ones as pairs of chunks of their rows; a block multiplies its part of the matrix with its transpose, leaving out pairs of one component
   and pairs whose sizes, or a common column's places in both rows, rule a link out.  Overlap counts are summed over blocks, and pairs that can't reach the needed
   overlap even if all other columns agreed are dropped.
4. *Verify*.  The pairs left are compared by their whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BINARY, INT, LONG, bitmap, discard, lean, looked_up, schema, slot, stored
from .shingles import U, mix, shingles, spans

#: Min-hashes of a profile, and how many must agree for the collapsing step to compare two classes.
MINS, AGREE = 8, 3
#: Members of a group that a tile of it holds, about.
TILE = 512
#: Shingles that a block of texts counts before it tells which repeat, and how often one must.
COUNTED, REPEATS = 1_000_000, 2
#: Most entries of the list of common shingles (8 bytes each).  It orders columns only; results don't depend on it.
COMMON = 1 << 19
#: Matrix entries that a block of columns has, about.
ENTRIES = 1_000_000
#: Blocks at least.  A pair is told once by each block that it meets in.
BLOCKS = 6
#: Pairs that a block looks at together.
TOGETHER = 500_000
#: Rows of a column that one task pairs with one another, about: longer columns are cut into chunks, dealt in pairs.
CHUNK = 4096

_SEEDS = np.random.default_rng(99).integers(1, 1 << 63, MINS, dtype=np.uint64) | U(1)


def needed(n, percent: int) -> np.ndarray:
    """Least overlap of sets that have n members between them, for a similarity of percent."""
    return -(-percent * n // (100 + percent))


def kept_columns(n, percent: int):
    """How many of a set's first columns may hold its first common one."""
    return n - -(-percent * n // 100) + 1


@lean
def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def common():
        u, n = np.unique(np.concatenate(held), return_counts=True)
        u, n = u[n >= REPEATS], n[n >= REPEATS]
        return pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(u), pa.int64()), "n": pa.array(n.astype(np.int32)), "sig": pa.nulls(len(u), pa.binary()), "mins": pa.nulls(len(u), pa.list_(pa.int64())), "common": pa.array(u.view(np.int64))})

    for batch in batches:
        n, sig, mins = [], [], []
        for h in spans(batch.column(1)):
            s = shingles(h)
            n.append(len(s))
            sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            with np.errstate(over="ignore"):
                mins.append([int((mix(s * x)).min().view(np.int64)) for x in _SEEDS] if len(s) else None)
            held.append(s)
            size += len(s)
            if size >= COUNTED:
                yield common()
                held, size = [], 0
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(n, pa.int32()), "sig": pa.array(sig, pa.binary()), "mins": pa.array(mins, pa.list_(pa.int64())), "common": pa.nulls(len(n), pa.int64())})
    if held:
        yield common()


def _sets(wanted: bytes):
    """The sets of documents whose bit is set."""
    bits = np.frombuffer(wanted, np.uint8)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(2))
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "members": pa.array([shingles(h).tobytes() for h in spans(batch.column(1))], pa.binary())})

    return run


def _compare(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = docs.select("doc_id", "text", slot("doc_id").alias("s")).mapInArrow(_sets(bitmap(ends, "id")), schema(doc_id=LONG, members=BINARY))
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("of_b")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("of_a")), "a")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(_compare(percent), schema(a=LONG, b=LONG)).distinct()


def _tile(percent: int):
    """Links of a tile's guests with its residents of other components; one for each guest and component is enough."""

    @lean
    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_home, guests = [], []
        for batch in parts:
            for rep, comp, guest, members in zip(*(batch.column(c) for c in ("rep", "comp", "guest", "members")), strict=True):
                (guests if guest.as_py() else at_home).append((rep.as_py(), comp.as_py(), np.frombuffer(members.as_buffer(), U).copy()))
        if not at_home or not guests:
            return
        n = np.array([len(x[2]) for x in at_home])
        cols, row = np.concatenate([x[2] for x in at_home]), np.repeat(np.arange(len(n)), n)
        order = np.argsort(cols, kind="stable")
        cols, row = cols[order], row[order]
        out = set()
        for rep, comp, s in guests:
            lo, hi = np.searchsorted(cols, s, "left"), np.searchsorted(cols, s, "right")
            k = hi - lo
            met = np.bincount(row[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)], minlength=len(n))
            found = {}
            for i in np.flatnonzero(100 * met >= percent * (n + len(s) - met)):
                if at_home[i][1] != comp:
                    found.setdefault(at_home[i][1], at_home[i][0])
            out.update((min(rep, x), max(rep, x)) for x in found.values())
        a, b = zip(*sorted(out), strict=True) if out else ((), ())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _first_columns(common: np.ndarray, percent: int):
    """Each document's first columns: rarer than those listed (in order of hash), then the listed ones, commonest last."""
    order = np.argsort(common)
    listed, rank = common[order], order.astype(np.int64)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sig = [], []
            for h in spans(batch.column(1)):
                s = shingles(h)
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keep = int(kept_columns(len(s), percent)) if len(s) else 0
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, s), len(listed) - 1)
                    hit = listed[at] == s
                    if hit.any():
                        s = np.concatenate([s[~hit], s[hit][np.argsort(-rank[at[hit]], kind="stable")]])
                out.append(s[:keep].tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "sig": pa.array(sig, pa.binary()), "columns": pa.array(out, pa.binary())})

    return run


def _kept_counts(first_columns, listed: np.ndarray):
    """How many rows of a batch keep each of the listed columns (in order of hash)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in first_columns(batches):
            h, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), U) for x in batch.column(2)]), return_counts=True)
            hit = listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[hit].view(np.int64)), "n": pa.array(n[hit])})

    return run


def chunks(h: np.ndarray, ids: np.ndarray, long: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of long columns, once for each pair of chunks that theirs is in: (entry, column and pair as a hash, side).

    Sides 0 and 1 are the pair's two chunks, which are only paired with one another; 2 is a chunk with itself."""
    at = np.minimum(np.searchsorted(long, h), max(0, len(long) - 1))
    hit = np.flatnonzero(long[at] == h) if len(long) else np.zeros(0, np.int64)
    m = cut[at[hit]] if len(hit) else np.zeros(0, np.int64)
    own = (mix(mix(ids[hit].astype(U)) + U(7)) % m.astype(U)).astype(np.int64) if len(hit) else m
    entry, mine, n = np.repeat(hit, m), np.repeat(own, m), np.repeat(m, m)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(m) - m, m)
    with np.errstate(over="ignore"):
        key = mix(h[entry] ^ mix((np.minimum(mine, other) * n + np.maximum(mine, other) + 1).astype(U)))
    return entry, key, np.where(mine == other, 2, mine > other).astype(np.int8)


def _deal(blocks: int, long: np.ndarray, into: np.ndarray):
    """Rows (block, documents, sizes, components, entries' documents, places, columns and sides) of packed arrays, one for
    each block and batch."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, comp, group = (np.asarray(batch.column(i)) for i in range(4))
            cols = [np.frombuffer(x.as_buffer(), U) for x in batch.column(4)]
            row = np.repeat(np.arange(len(cols), dtype=np.int32), [len(x) for x in cols])
            if not len(row):
                continue
            h, place = np.concatenate(cols), np.concatenate([np.arange(len(x), dtype=np.int32) for x in cols])
            entry, key, side = chunks(h, ids[row], long, into)
            whole = np.ones(len(h), bool)
            whole[entry] = False
            h, row, place, side = np.concatenate([h[whole], key]), np.concatenate([row[whole], row[entry]]), np.concatenate([place[whole], place[entry]]), np.concatenate([np.full(int(whole.sum()), 2, np.int8), side])
            block = (mix(h) % U(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.diff(block[order])) + 1
            rows = []
            for part in np.split(order, cut):
                docs, at = np.unique(row[part], return_inverse=True)
                rows.append((int(block[part[0]]), ids[docs].tobytes(), n[docs].astype(np.int32).tobytes(), comp[docs].tobytes(), group[docs].tobytes(), at.astype(np.int32).tobytes(), place[part].tobytes(), h[part].tobytes(), side[part].tobytes()))
            block, *packed = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["block", "docs", "sizes", "comps", "groups", "at", "places", "cols", "sides"])

    return run


def _product(percent: int):
    """Overlap counts within a block of columns, of pairs that lie in different components and whose sizes allow a link."""

    @lean
    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, comp, group, at, place, h, side, base = [], [], [], [], [], [], [], [], 0
        for batch in parts:
            for _, a, b, c, g, d, f, e, x in zip(*batch.columns, strict=True):
                ids.append(np.frombuffer(a.as_buffer(), np.int64))
                n.append(np.frombuffer(b.as_buffer(), np.int32))
                comp.append(np.frombuffer(c.as_buffer(), np.int64))
                group.append(np.frombuffer(g.as_buffer(), np.int64))
                at.append(np.frombuffer(d.as_buffer(), np.int32).astype(np.int64) + base)
                place.append(np.frombuffer(f.as_buffer(), np.int32))
                h.append(np.frombuffer(e.as_buffer(), U))
                side.append(np.frombuffer(x.as_buffer(), np.int8))
                base += len(ids[-1])
        ids, n, comp, group, at, place, h, side = (np.concatenate(x) for x in (ids, n, comp, group, at, place, h, side))
        order = np.argsort(h)
        h, at, place, side = h[order], at[order], place[order], side[order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        several = same[:-1] | same[1:]
        h, at, place, side = h[several], at[several], place[several], side[several]
        order = np.lexsort((comp[at], h))
        h, at, place, side = h[order], at[order], place[order], side[order]
        if not len(h):
            return
        edge = np.flatnonzero(np.concatenate([h[1:] != h[:-1], [True]])) + 1
        list_end = edge[np.searchsorted(edge, np.arange(len(h)), "right")]
        c = comp[at]
        edge = np.flatnonzero(np.concatenate([(h[1:] != h[:-1]) | (c[1:] != c[:-1]), [True]])) + 1
        own_end = edge[np.searchsorted(edge, np.arange(len(h)), "right")]
        count = list_end - own_end  # partners of other components, later in the same column
        total = np.cumsum(count)
        keys, sums, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while lo < len(h):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + TOGETHER, "right")))
            k = count[lo:hi]
            left = np.repeat(np.arange(lo, hi), k)
            right = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(own_end[lo:hi], k)
            x, y = at[left], at[right]
            i, j = place[left], place[right]
            # what both can have before, at and after a column that is the i-th of one and the j-th of the other
            fits = np.minimum(i, j) + 1 + np.minimum(n[x] - i, n[y] - j) - 1 >= needed(n[x].astype(np.int64) + n[y], percent)
            fits &= group[x] != group[y]  # the tiles have compared these
            fits &= (side[left] == 2) | (side[left] != side[right])
            x, y = x[fits], y[fits]
            new, add = np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([sums, add]), len(keys)).astype(np.int64)
            lo = hi
        if not len(keys):
            return
        x, y = keys // len(ids), keys % len(ids)
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        for i in range(0, len(x), 100_000):
            p, q = x[i : i + 100_000], y[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({"a": ids[p], "b": ids[q], "na": n[p], "nb": n[q], "met": sums[i : i + 100_000].astype(np.int32)})

    return run


def _commonest(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles and their counts, most of all first: those above the least count that COMMON or fewer exceed."""
    sizes = sorted(counted.groupBy(F.least(F.col("n"), F.lit(10_000)).alias("n")).count().collect(), reverse=True)
    total = np.cumsum([x[1] for x in sizes])
    least = next((n for (n, _), t in zip(sizes, total, strict=True) if t > COMMON), 0)
    found = counted.where(F.col("n") > least).select("common", "n").toArrow()
    h, n = np.asarray(found.column(0)).view(U), np.asarray(found.column(1))
    order = np.lexsort((h, -n))[:COMMON]
    return h[order], n[order]


def jaccard_components(documents: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``documents`` (columns ``doc_id``, ``text``; others are ignored).

    Two documents link when 100 * intersection >= percent * union of their sets of 5-word shingles.  Null and blank
    texts have an empty set and link with nothing: their component is themselves.  Equal sets always link.  Repeated
    rows each give a row; rows that share a doc_id are one document, linked with whatever one of them links with.  A
    row without a doc_id can't be linked: its component is null.  An empty table gives an empty table."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile, profile_at = stored(docs.mapInArrow(_profile, "doc_id long, n int, sig binary, mins array<long>, common long"), "profile")
    rows = profile.where("common is null").select("doc_id", "n", "sig", "mins")
    classes = rows.where("doc_id is not null and n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("mins").alias("mins"))
    classes, classes_at = stored(classes, "classes")
    docs = docs.where("doc_id is not null")

    # collapse: each class against the first class of the group that shares most of its min-hashes
    keys = classes.select("rep", "n", F.posexplode("mins").alias("at", "h"))
    firsts = keys.groupBy("at", "h").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = looked_up(keys, firsts, ["at", "h"], MINS * classes.count()).where("a < rep").groupBy("rep", "a").agg(F.count("*").alias("agree")).where(F.col("agree") >= AGREE)
    best = shared.groupBy("rep").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a"))
    near, near_at = stored(best.select("a", F.col("rep").alias("b")), "near")
    first_links, first_at = stored(_linked(docs, near, percent), "links")
    labels, labels_at = components(first_links)
    # and each group's components with one another, by whole sets: what isn't of the largest meets every tile of the group
    member = near.select(F.col("a").alias("g"), F.col("b").alias("rep")).union(near.select(F.col("a").alias("g"), F.col("a").alias("rep")).distinct())
    member = member.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("g", "rep", F.coalesce("component", "rep").alias("comp"))
    largest = member.groupBy("g", "comp").agg(F.count("*").alias("k")).groupBy("g").agg(F.sum("k").alias("n"), F.count("*").alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("most")).where("comps > 1")
    cut = lambda k: F.ceil(k / TILE).cast("int")
    largest = largest.select("g", "n", "main", cut(F.col("n")).alias("tiles"), cut(F.col("n") - F.col("most")).alias("halls"))
    member, member_at = stored(member, "members")
    member = looked_up(member, largest, ["g"], member.count())
    # residents by tile and guests by hall: each tile meets each hall in a task of its own
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = member.select("g", deal("tiles").alias("tile"), every("halls").alias("hall"), "rep", "comp", F.lit(False).alias("guest"))
    guests = member.where("comp != main").select("g", "tiles", deal("halls").alias("hall"), "rep", "comp").select("g", every("tiles").alias("tile"), "hall", "rep", "comp", F.lit(True).alias("guest"))
    tiles, tiles_at = stored(home.union(guests), "tiles")
    sets = docs.select("doc_id", "text", slot("doc_id").alias("s")).mapInArrow(_sets(bitmap(tiles, "rep")), schema(doc_id=LONG, members=BINARY))
    tiled = tiles.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("g", "tile", "hall", "rep", "comp", "guest", "members").groupBy("g", "tile", "hall").applyInArrow(_tile(percent), schema(a=LONG, b=LONG))
    more_links, more_links_at = stored(first_links.union(tiled).distinct(), "links")
    discard(spark, first_at, labels_at, tiles_at, member_at)
    labels, labels_at = components(more_links)
    of_group = near.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("g"))

    # product
    entries = classes.agg(F.sum(kept_columns_sql(percent))).first()[0] or 0
    common, counts = _commonest(profile.where("common is not null").groupBy("common").agg(F.sum("n").alias("n")))
    first_columns = _first_columns(common, percent)
    firsts = docs.mapInArrow(first_columns, schema(doc_id=LONG, sig=BINARY, columns=BINARY))
    long, cut = np.zeros(0, U), np.zeros(0, np.int64)
    frequent = np.sort(common[counts > CHUNK])
    if len(frequent):  # columns that so many rows have; how many keep them takes another look
        kept = docs.mapInArrow(_kept_counts(first_columns, frequent), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > CHUNK).toArrow()  # at most COMMON
        order = np.argsort(np.asarray(kept.column(0)).view(U))
        long, cut = np.asarray(kept.column(0)).view(U)[order], -(-np.asarray(kept.column(1))[order] // CHUNK)
    reps = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").join(of_group, "rep", "left")
    reps = reps.select(F.col("rep").alias("doc_id"), "sig", F.col("n").alias("size"), F.coalesce("component", "rep").alias("comp"), F.coalesce("g", "rep").alias("g"))
    blocks = max(BLOCKS, -(-int(entries) // ENTRIES))
    dealt = firsts.join(reps, ["doc_id", "sig"]).select("doc_id", "size", "comp", "g", "columns").mapInArrow(_deal(blocks, long, cut), "block int, docs binary, sizes binary, comps binary, groups binary, at binary, places binary, cols binary, sides binary")
    met = dealt.repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block").groupBy("block").applyInArrow(_product(percent), schema(a=LONG, b=LONG, na=INT, nb=INT, met=INT))
    met = met.groupBy("a", "b", "na", "nb").agg(F.sum("met").alias("met"))
    rest = lambda c: F.col(c) - kept_columns_sql(percent, c)
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    open_pairs, open_at = stored(met.where(F.col("met") + F.greatest(rest("na"), rest("nb")) >= need).where("a != b").select("a", "b"), "pairs")
    of_class = classes.select("sig", "rep")
    one_id = rows.join(of_class, "sig").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("doc_id is not null and a < b").select("a", "b")
    links = more_links.union(_linked(docs, open_pairs, percent)).union(one_id)
    labels2, _ = components(links)
    discard(spark, near_at, open_at, labels_at, more_links_at)
    of_class = of_class.join(labels2.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_class, "sig", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def kept_columns_sql(percent: int, n: str = "n") -> F.Column:
    return F.col(n) - F.ceil(F.col(n) * F.lit(percent) / F.lit(100)).cast("int") + 1
