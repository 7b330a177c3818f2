"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's set is its 5-word shingles, or its whole sequence of k words as one k-word shingle where it has fewer; it is
looked for among the shingles of k words that documents hold.  Items are partitioned by k and size (powers of two).  Both
sides are sketched by one min-hash order: an item by its smallest values, as many as its partition takes, a document, for
each partition, by its values up to the largest that any item's sketch there has.  So a document's sketch for large items
is a fraction of its shingles, for short ones nearly all of them, however long the document is.

A partition's sketch length k turns the stated containment into a count: of an item's n shingles n - ceil(t n) may be
missing, so a document that contains it shares k less that many of the k sketched values at least.  As k is above that
number, the search has no misses; its candidates are verified by all their shingles.

The benchmark is read in blocks of bounded size, each sent to the executors and matched with all documents; documents
never move.  The pass over the texts works on whole Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import kept_columns
from .shared import BINARY, DOUBLE, INT, LONG, schema
from .shingles import U, mix, ordered, pieces, shingles, spans, words

#: Shingles of benchmark items in a block (8 bytes each), about.
BLOCK_SHINGLES = 1_000_000
#: Bits of the filter that most values of a document don't pass.
FILTER_BITS = 20
#: Words of a shingle.
WORDS = 5
#: Share of an item's values that its sketch has, more than may be missing.
SKETCHED = 50


def sketch_length(n: int, percent: int) -> int:
    """Values in the sketch of an item of n shingles; ``percent`` of its partition's largest size are wanted."""
    upper = 1 << max(0, n - 1).bit_length()  # the largest size of its partition
    return min(n, max(-(-SKETCHED * upper // 100), int(kept_columns(upper, percent))))


class Partition:
    """Sketches of the items of one shingle length and about one size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        keys, owner, self.need = [], [], {}
        for i, s in items:  # sets are sorted by hash, so the smallest values come first
            k = sketch_length(len(s), percent)
            keys.append(s[:k])
            owner.append(np.full(k, i))
            self.need[i] = k - (len(s) - -(-percent * len(s) // 100))
        key, own = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.cut = key[order], own[order], key.max()
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.slots(self.key)] = True

    @staticmethod
    def slots(h: np.ndarray) -> np.ndarray:
        return (mix(h) >> U(64 - FILTER_BITS)).astype(np.int64)

    def candidates(self, row: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, item) of rows whose sketches, drawn from values s, share enough with the item's."""
        sketch = np.flatnonzero(s <= self.cut)
        sketch = sketch[self.filter[self.slots(s[sketch])]]
        row, s = row[sketch], s[sketch]
        lo, hi = np.searchsorted(self.key, s, "left"), np.searchsorted(self.key, s, "right")
        k = hi - lo
        which = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)
        if not len(which):
            return
        shared = np.unique(np.stack([np.repeat(row, k), self.owner[which], which], 1), axis=0)[:, :2]  # a value counts once
        pairs, counts = np.unique(shared, axis=0, return_counts=True)
        yield from ((int(r), int(i)) for (r, i), n in zip(pairs, counts, strict=True) if n >= self.need[i])


class Sketches:
    """The items of a block, by shingle length and partition."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], percent: int):
        self.items, self.percent = items, percent
        parts: dict[tuple[int, int], list] = {}
        for i, (_, words_, s) in enumerate(items):
            parts.setdefault((words_, max(0, len(s) - 1).bit_length()), []).append((i, s))
        self.lengths: dict[int, list[Partition]] = {}
        for (words_, _), own in sorted(parts.items()):
            self.lengths.setdefault(words_, []).append(Partition(own, percent))

    def matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shingles that both have) for each pair that holds enough of the item."""
        out, base = [], 0
        for part in pieces(column):
            out += ((base + r, i, n) for r, i, n in self._matches(part))
            base += len(part)
        return out

    def _matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        h, at = words(column)
        out = []
        for k, partitions in self.lengths.items():
            if len(h) < k:
                continue
            s = ordered(h, k)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(s)]
            inside = np.flatnonzero(np.arange(len(s)) + k <= at[row + 1])
            row, s = row[inside], s[inside]
            last, own = -1, None
            for r, i in sorted(x for p in partitions for x in p.candidates(row, s)):
                if r != last:
                    last, own = r, np.unique(ordered(h[at[r] : at[r + 1]], k))
                item = self.items[i][2]
                both = int(np.isin(item, own, assume_unique=True).sum())
                if 100 * both >= self.percent * len(item):
                    out.append((r, i, both))
        return out


def _blocks(benchmark: DataFrame, percent: int) -> Iterator[Sketches]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(min(WORDS, len(h)), shingles(h, WORDS).tobytes()) for h in spans(batch.column(1))]
            yield pa.RecordBatch.from_pydict({"item_id": batch.column(0), "words": pa.array([k for k, _ in found], pa.int32()), "members": pa.array([x for _, x in found], pa.binary())})

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(sets, schema(item_id=LONG, words=INT, members=BINARY)).where("item_id is not null and words > 0").distinct()
    total = items.agg(F.sum(F.length("members"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (8 * BLOCK_SHINGLES)))
    for b in range(blocks):
        found = items.where(F.pmod(F.xxhash64("members"), F.lit(blocks)) == b).collect()  # about BLOCK_SHINGLES
        yield Sketches([(x[0], x[1], np.frombuffer(x[2], U)) for x in sorted(found)], percent)


def contained_items(documents: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` for each document that holds percent of an item's shingles.

    ``documents`` needs ``doc_id, text``, ``benchmark`` ``item_id, text``; other columns are ignored.  An item's set is
    its distinct 5-word shingles (A-Z lower-cased); with fewer words its whole sequence, which a document holds that has
    these words in a row anywhere.  Null and blank texts on either side match nothing; items without an id are left out.  Repeated documents each give their rows, null ids
    stay null; items of equal id and text count once.  An empty table on either side gives no rows."""
    out = None
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in _blocks(benchmark, percent):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = block.matches(batch.column(1))
                n = [len(block.items[i][2]) for _, i, _ in found]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array([r for r, _, _ in found], pa.int64())), "item_id": pa.array([block.items[i][0] for _, i, _ in found], pa.int64()), "n_shared": pa.array([b for _, _, b in found], pa.int64()), "n_item": pa.array(n, pa.int64()), "containment": pa.array([b / m for (_, _, b), m in zip(found, n, strict=True)], pa.float64())})

        part = docs.mapInArrow(run, schema(doc_id=LONG, item_id=LONG, n_shared=LONG, n_item=LONG, containment=DOUBLE))
        out = part if out is None else out.unionAll(part)
    return out


def clean_documents(documents: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that hold percent of no item.  Nothing is shuffled."""
    at = documents.columns.index("text")
    for block in _blocks(benchmark, percent):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _, _ in block.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
