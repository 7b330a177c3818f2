"""Occurrences of patterns in contigs: every one, overlaps included.

Long contigs are cut into tiles that overlap by the longest pattern less one base, so a chromosome is many rows and no
task holds it; a match belongs to the tile that it starts in.  The Arrow kernel turns bases of a whole batch into two-bit
codes and looks rolling codes up; ``catalyst`` says the same with built-in expressions and is what tests compare it with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Pattern

TILE = 1 << 16
_CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i
#: Pattern lengths whose codes index a table; longer ones are found by binary search.
TABLE = 10
#: Bases of a code; of longer patterns the code of the first ones is found, then the rest compared.
CODED = 31
#: Bases of a batch of pieces, about.
BATCH = 1 << 22
#: Bases that are looked at together: their codes take many times the memory of the texts.
SPAN = 1 << 18


class Kernel:
    """For each pattern length, which pattern each code is (of its first bases), counted from 1."""

    def __init__(self, patterns: list[Pattern]):
        self.patterns = sorted((p for p in patterns if p.pattern and set(p.pattern) <= set("ACGT")), key=lambda p: (p.length, p.pattern))
        self.text = pa.array([p.pattern for p in self.patterns], pa.string())
        self.length, self.forward, self.canonical = (np.array([getattr(p, k) for p in self.patterns], t) for k, t in (("length", np.int64), ("is_forward", bool), ("is_canonical", bool)))
        self.by_length: dict[int, tuple[np.ndarray | None, np.ndarray, np.ndarray]] = {}
        for length in sorted({p.length for p in self.patterns}):
            own = np.flatnonzero(self.length == length)
            codes = np.array([self.code(self.patterns[i].pattern[:CODED]) for i in own], np.int64)
            order = np.argsort(codes, kind="stable")
            table = None
            if length <= TABLE:
                table = np.zeros(4**length, np.int32)
                table[codes] = own + 1
            self.by_length[length] = table, codes[order], own[order] + 1

    @staticmethod
    def code(s: str) -> int:
        n = 0
        for c in s:
            n = n * 4 + "ACGT".index(c)
        return n

    def _long(self, data: np.ndarray, at: np.ndarray, first: np.ndarray, codes: np.ndarray, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and patterns, of those that begin with the codes found, that agree in their other bases."""
        rest = {}
        for code, i in zip(codes, which, strict=True):
            rest.setdefault(int(code), {})[self.patterns[i - 1].pattern.encode()] = i
        found = [(p, rest[int(c)].get(data[p : p + length].tobytes(), 0)) for p, c in zip(at, first, strict=True)]
        found = [x for x in found if x[1]]
        return (np.array([x[i] for x in found], np.int64) for i in range(2))

    def find(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and pattern (from 0) of each match in texts data[off[i] : off[i + 1]], in this order."""
        found = [self._spanned(data, off, at) for at in range(0, len(data), SPAN)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def _spanned(self, data: np.ndarray, off: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these the matches that start in data[begin : begin + SPAN]."""
        data = data[begin : begin + SPAN + int(self.length.max(initial=1)) - 1]
        base = _CODE[data]
        bad = np.concatenate([[0], np.cumsum(base == 255)])
        rows, places, found = [], [], []
        for length, (table, codes, which) in self.by_length.items():
            n = min(SPAN, len(base) - length + 1)
            if n <= 0:
                continue
            rolled = np.zeros(n, np.int64 if table is None else np.int32)
            for j in range(min(length, CODED)):
                rolled = rolled * 4 + (base[j : j + n] & 3)
            if table is not None:
                hit = table[rolled]
            else:
                at = np.minimum(np.searchsorted(codes, rolled), len(codes) - 1)
                hit = np.where(codes[at] == rolled, which[at], 0)
            at = np.flatnonzero((hit > 0) & (bad[length : length + n] == bad[:n]))
            pattern = hit[at]
            if length > CODED:
                at, pattern = self._long(data, at, rolled[at], codes, which, length)
            at = at + begin
            row = np.searchsorted(off, at, "right") - 1
            inside = at + length <= off[row + 1]
            rows.append(row[inside])
            places.append((at - off[row])[inside])
            found.append(pattern[inside].astype(np.int64) - 1)
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        row, place, pattern = (np.concatenate(x) for x in (rows, places, found))
        order = np.lexsort((self.length[pattern], place, row))
        return row[order], place[order], pattern[order]


def ascii_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts, and where each begins and ends; letters beyond ASCII are question marks, null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    if (data > 127).any():
        return ascii_texts(pa.array([x.as_py().encode("ascii", "replace").decode() for x in column], pa.large_string()))
    return data, off - off[0]


def pieces(contigs: DataFrame, keys: list[str], step: int, size: int) -> DataFrame:
    """``keys, piece, piece_start, bases``: of each contig the ``size`` bases (or what is left) from 0, step, 2 * step, ...

    A contig is gone through once, whatever its length.  Letters beyond ASCII, which no pattern has, become question marks."""
    table = contigs.select(*keys, "bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held):
            rows = pa.array([i for i, *_ in held], pa.int64())
            return pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(keys))), pa.array([n for _, n, _ in held], pa.int32()), pa.array([n * step for _, n, _ in held], pa.int64()), pa.array([x for *_, x in held], pa.string())], names=[*keys, "piece", "piece_start", "bases"])

        for batch in batches:
            held, bases = [], 0
            for i, x in enumerate(batch.column(len(keys))):
                text = x.as_py() or ""
                text = text if text.isascii() else text.encode("ascii", "replace").decode()
                for n, at in enumerate(range(0, max(1, len(text)), step)):
                    held.append((i, n, text[at : at + size]))
                    bases += len(held[-1][2]) + 100
                    if bases >= BATCH:
                        yield batch_of(held)
                        held, bases = [], 0
            if held:
                yield batch_of(held)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != "bases")
    return table.mapInArrow(run, f"{fields}, piece int, piece_start long, bases string")


def tiles(contigs: DataFrame, longest: int, tile: int = TILE) -> DataFrame:
    return pieces(contigs, KEYS, tile, tile + longest - 1).withColumnsRenamed({"piece": "tile", "piece_start": "tile_start"})


#: Columns of a match: place in the contig and in the sequence.
KEYS = ["seq_pos", "header", "path_size", "contig_no", "contig_start", "contig_len"]
MATCH = "pos long, len int, is_forward boolean, is_canonical boolean, seq string"


def matches(contigs: DataFrame, patterns: list[Pattern], tile: int = TILE) -> DataFrame:
    """All matches: the keys of their contig, ``pos`` in it, ``abs_pos`` in the sequence, ``len``, strand, canonical, text."""
    longest = max((p.length for p in patterns), default=1)
    kernel = Kernel(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, pattern = kernel.find(*ascii_texts(batch.column(len(KEYS) + 1)))
            own = place < tile
            row, place, pattern = row[own], place[own], pattern[own]
            begin = np.asarray(batch.column(len(KEYS)))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(KEYS))), pa.array(begin[row] + place, pa.int64()), pa.array(kernel.length[pattern].astype(np.int32)), pa.array(kernel.forward[pattern]), pa.array(kernel.canonical[pattern]), kernel.text.take(pa.array(pattern))], names=[*KEYS, "pos", "len", "is_forward", "is_canonical", "seq"])

    cut = tiles(contigs, longest, tile).select(*KEYS, "tile_start", "bases")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in KEYS)
    return cut.mapInArrow(run, f"{fields}, {MATCH}").withColumn("abs_pos", F.col("contig_start") + F.col("pos"))


def catalyst(contigs: DataFrame, patterns: list[Pattern], tile: int = 512) -> DataFrame:
    """The same with built-in expressions: each offset of short tiles against the pattern table."""
    spark = contigs.sparkSession
    longest = max((p.length for p in patterns), default=1)
    known = spark.createDataFrame([(p.pattern, p.is_forward, p.is_canonical, p.length) for p in patterns], "seq string, is_forward boolean, is_canonical boolean, len int")
    cut = tiles(contigs, longest, tile)
    spread = cut.withColumn("in_tile", F.explode(F.sequence(F.lit(0), F.least(F.lit(tile), F.length("bases")) - 1)))
    spread = spread.where("length(bases) > 0").withColumn("len", F.explode(F.array(*(F.lit(x) for x in sorted({p.length for p in patterns})))))
    spread = spread.where(F.col("in_tile") + F.col("len") <= F.length("bases")).withColumn("seq", F.substr("bases", F.col("in_tile") + 1, F.col("len")))
    found = spread.join(F.broadcast(known), ["seq", "len"])  # as many rows as there are patterns
    return found.withColumn("pos", F.col("tile_start") + F.col("in_tile")).select(*KEYS, "pos", "len", "is_forward", "is_canonical", "seq").withColumn("abs_pos", F.col("contig_start") + F.col("pos"))


def distance_counts(contigs: DataFrame, motifs: list[str], tile: int = TILE) -> DataFrame:
    """``seq_pos, distance, n``: at how many places of its contigs, overlaps included, a sequence differs by so many bases
    from the nearest of ``motifs``, which have one length."""
    k, coded = len(motifs[0]), [np.frombuffer(m.encode(), np.uint8) for m in motifs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            _, offsets, data = column.buffers()
            off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
            off = off - off[0]
            n = max(0, len(data) - k + 1)
            nearest = np.full(n, k, np.uint8)
            for motif in coded:
                nearest = np.minimum(nearest, sum(((data[j : j + n] != c).astype(np.uint8) for j, c in enumerate(motif)), np.zeros(n, np.uint8)))
            row = np.repeat(np.arange(len(column)), np.diff(off))[:n]
            place = np.arange(n)
            own = (place + k <= off[row + 1]) & (place - off[row] < tile)
            counts = np.bincount(row[own] * (k + 1) + nearest[own], minlength=len(column) * (k + 1))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at // (k + 1))), pa.array((at % (k + 1)).astype(np.int32)), pa.array(counts[at])], names=["seq_pos", "distance", "n"])

    cut = tiles(contigs, k, tile).select("seq_pos", "bases")
    found = cut.mapInArrow(run, f"seq_pos {cut.schema['seq_pos'].dataType.simpleString()}, distance int, n long")
    return found.groupBy("seq_pos", "distance").agg(F.sum("n").alias("n"))


def in_tips(found: DataFrame, limit: int) -> DataFrame:
    """Matches that lie wholly in the first or last ``limit`` bases of their contig; all if it is no longer than both."""
    n = F.col("contig_len")
    return found.where((n <= 2 * limit) | (F.col("pos") + F.col("len") <= limit) | (F.col("pos") >= n - limit))


def in_windows(found: DataFrame, window: int, step: int) -> DataFrame:
    """Matches that some window holds whole: the last one to start at or before them reaches furthest."""
    return found.where(F.col("pos") + F.col("len") <= F.floor(F.col("pos") / step) * step + window)


def near_ends(found: DataFrame, limit: int) -> DataFrame:
    """Non-canonical matches near an end of their contig, the limit itself included."""
    return found.where(~F.col("is_canonical") & ((F.col("pos") <= limit) | (F.col("pos") >= F.greatest(F.col("contig_len") - limit, F.lit(0)))))
