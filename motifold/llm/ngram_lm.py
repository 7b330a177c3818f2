"""LM scoring with an Elias-Fano n-gram trie.

The model is a word trigram, interpolated with the bigram and the smoothed unigram:

    p3(w | u v) = (1 - BETA) c(u, v, w) / c(u, v) + BETA p2(w | v)    if the training texts have (u, v), else p2(w | v)
    p2(w | v)   = (1 - BETA) c(v, w) / c(v) + BETA p1(w)              if they have v, else p1(w)
    p1(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))

Each sums to one over all words and one unknown.  Nothing holds the model or the corpus whole.  Texts are cut once into
*blocks*, which are stored: a dictionary of word hashes and the texts as places in it.  The trie's levels are dealt into
*shards* by context.  Level by level, each block asks each shard for the different n-grams that it has, with their counts
in its training texts.  A shard builds its part of the level from all that it was asked, and answers.

A level lies in a memory-mapped file: contexts and the successors of each, both Elias-Fano sequences, as are the pointers
from one to the other; a successor is found by its fingerprint relative to its context's range.  Its share of its
context, discounted, is quantised to 16 bits.  What a block learns from one level (how often words and pairs occur) tells
it what to ask of the next: nothing for contexts that have no successors there, and those of a hot context, which has
more than HOT, from shards dealt by successor, with the context's count sent along."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BINARY, DOUBLE, INT, LONG, discard, lean, schema, stored
from .shingles import U, mix, words

#: Share of probability that goes to the next lower order.
BETA = 0.4
#: Tokens of a block, about; n-grams that a shard is asked for, about; occurrences from which a context is hot.
PACKED, SHARD, HOT = 1_000_000, 2_500_000, 50_000
START, END = U(0x5354415254), U(0x454E44)
#: Bits of the fingerprints of successors and contexts.
PRINT, CONTEXT = 40, 48
#: Steps of a quantised share to a decade, and what stands for none.
GRID, NONE = 4000, 65535
#: Questions that a shard looks up together.
TOGETHER = 500_000


def pack(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(x: pa.Scalar, kind) -> np.ndarray:
    raw = memoryview(x.as_buffer())
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], size, codec="zstd"), kind) if size else np.zeros(0, kind)


def pack_planes(x: np.ndarray) -> bytes:
    """Small numbers: all lowest bytes, then all second ones and so on, which says most in the first."""
    return pack(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T)


def unpack_planes(x: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(unpack(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_bits(x: np.ndarray, bits: int) -> bytes:
    """The lowest bytes of 64-bit numbers."""
    return pack(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8])


def unpack_bits(x: pa.Scalar, bits: int) -> np.ndarray:
    raw = unpack(x, np.uint8).reshape(-1, bits // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : bits // 8] = raw
    return out.view("<u8").ravel()


class EliasFano:
    """A monotone sequence of 64-bit numbers: low bits side by side, high bits in unary."""

    def __init__(self, values: np.ndarray, file):
        n = len(values)
        top = int(values[-1]) if n else 0
        self.n, self.low_bits = n, min(56, max(0, (top // max(1, n)).bit_length() - 1))
        high = (values >> U(self.low_bits)).astype(np.int64)
        ones = np.zeros(((int(high[-1]) if n else 0) + n + 8) // 8 * 8, bool)
        ones[high + np.arange(n)] = True
        self.at = [file.tell()]
        for lo in range(0, n if self.low_bits else 0, 1 << 17):
            part = values[lo : lo + (1 << 17)] & U((1 << self.low_bits) - 1)
            part = np.append(part, np.zeros(-len(part) % 8, U)).reshape(-1, 8)
            packed = np.zeros((len(part), self.low_bits + 8), np.uint8)
            for j in range(8):  # eight values take whole bytes, whatever the width
                byte, shift = j * self.low_bits >> 3, U(j * self.low_bits & 7)
                packed[:, byte : byte + 8] |= np.ascontiguousarray(part[:, j] << shift, "<u8").view(np.uint8).reshape(-1, 8)
            file.write(packed[:, : self.low_bits].tobytes())
        self.at.append(file.write(bytes(8)) + file.tell() - 8)
        self.at.append(file.write(np.packbits(ones, bitorder="little").tobytes()))
        file.write(bytes(8))

    def open(self, data: np.ndarray) -> EliasFano:
        low, unary, size = self.at
        # eight bytes from each byte on; as many follow the last value's
        self.low, unary = np.ndarray((max(0, unary - low - 7),), "<u8", data[low:unary], strides=(1,)), data[unary : unary + size]
        # where each value of the high bits begins: select over the zeros
        zeros = np.flatnonzero(np.unpackbits(unary, bitorder="little") == 0)
        self.starts = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(np.uint32 if self.n < 1 << 32 else np.int64)
        return self

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        return (self.low[at >> 3] >> (at & 7).astype(U)) & U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.starts, i, "right") - 1
        return (high.astype(U) << U(self.low_bits)) | self._lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 if it isn't there."""
        high = np.minimum(values >> U(self.low_bits), U(len(self.starts))).astype(np.int64)
        inside = high + 1 < len(self.starts)
        high = np.where(inside, high, 0)
        lo, hi = self.starts[high].astype(np.int64), np.where(inside, self.starts[np.minimum(high + 1, len(self.starts) - 1)], 0).astype(np.int64)
        hi = np.minimum(np.where(inside, hi, lo), self.n)
        low = values & U((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(values), U)
        end, open_ = hi.copy(), np.flatnonzero(lo < hi)
        while len(open_):  # all searches go on together
            mid = (lo[open_] + hi[open_]) // 2
            less = self._lows(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        hit = lo < end
        hit[hit] = self._lows(lo[hit]) == low[hit]
        return np.where(hit, lo, -1)


class Trie:
    """One level: contexts and their successors, in a memory-mapped file that is gone once the trie is."""

    def __init__(self, v: np.ndarray, w: np.ndarray, count: np.ndarray, total: np.ndarray, k: np.ndarray | int = 1):
        """n-grams in any order, some repeated: contexts, fingerprints of ``k`` successors of each, their occurrences;
        ``total`` is how often a context occurs where that is known, else 0 and all its n-grams are here.  ``asked`` are
        the different n-grams, ``which`` the place of each in them."""
        contexts, index = np.unique(v, return_inverse=True)
        known = np.zeros(len(contexts), np.int64)
        np.maximum.at(known, index, total.astype(np.int64))
        index = np.repeat(index, k)
        sums = np.bincount(index, count, len(contexts)).astype(np.int64)
        totals = np.where(known > 0, known, sums)
        key, self.which = np.unique(index.astype(U) << U(PRINT) | w, return_inverse=True)
        count = np.bincount(self.which, count, len(key))
        of = (key >> U(PRINT)).astype(np.int64)
        new = np.flatnonzero(np.diff(of, prepend=-1))
        self.asked = contexts[of[new]], np.diff(np.append(new, len(key))), key & U((1 << PRINT) - 1)
        key, count = key[count > 0], count[count > 0]
        of = (key >> U(PRINT)).astype(np.int64)
        code = np.rint(-np.log10((1 - BETA) * count / np.maximum(totals[of], 1)) * GRID)
        with tempfile.TemporaryFile() as file:
            self.roots = EliasFano(contexts, file)
            self.pointers = EliasFano(np.searchsorted(of, np.arange(len(contexts) + 1)).astype(U), file)
            self.children = EliasFano(key, file)
            self.codes = file.tell()
            file.write(np.clip(code, 0, NONE - 1).astype("<u2").tobytes() + bytes(2))
            file.flush()
            self.data = np.memmap(file, np.uint8, "r")
        for level in (self.roots, self.pointers, self.children):
            level.open(self.data)

    def successors(self, v: np.ndarray) -> np.ndarray:
        """How many different words follow each context."""
        root = self.roots.find(v)
        at = np.maximum(root, 0)
        return np.where(root >= 0, (self.pointers.get(at + 1) - self.pointers.get(at)).astype(np.int64), 0)

    def find(self, v: np.ndarray, k: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Quantised shares of k successors of each context, their fingerprints one after the other; NONE if not there."""
        root = np.repeat(self.roots.find(v), k)
        out = np.full(len(w), NONE, np.uint16)
        for lo in range(0, len(w), TOGETHER):
            at, r = slice(lo, lo + TOGETHER), root[lo : lo + TOGETHER]
            # relative to its context: the context's place stands above the fingerprint
            child = np.where(r >= 0, self.children.find(np.maximum(r, 0).astype(U) << U(PRINT) | w[at]), -1)
            c = self.codes + 2 * np.maximum(child, 0)
            out[at] = np.where(child >= 0, self.data[c].astype(np.uint16) | self.data[c + 1].astype(np.uint16) << np.uint16(8), NONE)
        return out


def share(code: np.ndarray) -> np.ndarray:
    """Discounted shares of their contexts."""
    return np.where(code == NONE, 0.0, 10.0 ** (-code.astype(float) / GRID))


def held_out(col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _freed(f):
    """Have a function of tables give memory back when it ends."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


#: A block: its tokens' number; its texts' ids, folds and sizes in tokens; its texts' words by place in its dictionary; what levels answered.
BLOCK = dict(block=LONG, n=LONG, ids=BINARY, held=BINARY, sizes=BINARY, tokens=BINARY, words=BINARY, counts=BINARY, pairs=BINARY)
#: A question: contexts, how many successors of each are asked for, the different ones and which each is, their counts,
#: and counts of hot contexts.
ASKED = dict(shard=INT, block=LONG, contexts=BINARY, sizes=BINARY, successors=BINARY, which=BINARY, counts=BINARY, totals=BINARY)
#: What a shard found for a block; or, of block -1, its tokens and different words.
ANSWER = dict(shard=INT, block=LONG, found=BINARY, n=LONG, v=LONG)


def _rows(rows: list[tuple], fields: dict) -> pa.Table:
    arrow = {INT: pa.int32(), LONG: pa.int64(), BINARY: pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, arrow[t]) for (name, t), c in zip(fields.items(), columns, strict=True)})


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts; the number tells one from another, and is kept, as the table is stored."""
    part, held, size, number = TaskContext.get().partitionId() << 32, [], 0, 0

    def block():
        texts = pa.Table.from_batches(held).combine_chunks()
        h, at = words(texts.column(1))
        own, tokens, counts = np.unique(np.insert(h, at[1:], END), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # the commonest first: small numbers
        rank = np.empty(len(own), np.uint32)
        rank[order] = np.arange(len(own))
        own, tokens = own[order], rank[tokens]
        ids = texts.column(0)
        folds = np.asarray(texts.column(2)).astype(np.uint8) + 2 * np.asarray(ids.is_null()).astype(np.uint8)
        return _rows([(part + number, len(tokens), pack(np.asarray(ids.fill_null(0))), pack(folds), pack((np.diff(at) + 1).astype(np.uint32)), pack_planes(tokens), pack(own), None, None)], BLOCK).to_batches()

    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            held.append(batch.slice(lo, 500))
            size += held[-1].column(1).nbytes // 6
            if size >= PACKED:
                yield from block()
                held, size, number = [], 0, number + 1
    if held:
        yield from block()


class Block:
    """A block's arrays, and its different n-grams."""

    def __init__(self, row: dict):
        self.number, self.ids, folds = row["block"].as_py(), unpack(row["ids"], np.int64), unpack(row["held"], np.uint8)
        self.held, self.null = (folds & 1).astype(bool), (folds & 2).astype(bool)
        self.sizes, self.tokens, self.words = unpack(row["sizes"], np.uint32).astype(np.int64), unpack_planes(row["tokens"]).astype(np.int64), unpack(row["words"], U)
        self.counts = unpack(row["counts"], np.int64) if row["counts"].is_valid else None
        self.train = np.repeat(~self.held, self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes

    def pairs(self) -> None:
        """Different pairs, by first word; which one each token ends; whose first word training texts have."""
        n = len(self.words)  # the start stands behind all words
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = n
        key, self.pair = np.unique(before * (n + 1) + self.tokens, return_inverse=True)
        self.v, self.w = key // (n + 1), key % (n + 1)
        # as many starts as ends
        self.of_context = np.append(self.counts, self.counts[self.words == END])[self.v]
        self.hashes = np.append(self.words, START)

    def triples(self, pairs: np.ndarray) -> None:
        """Different triples, by pair; which one each token but the first two's ends; ``pairs``: shares of pairs."""
        self.inner = np.ones(len(self.tokens), bool)
        self.inner[self.first] = False
        at = np.flatnonzero(self.inner)
        key, self.triple = np.unique(self.pair[at - 1] * (len(self.words) + 1) + self.tokens[at], return_inverse=True)
        self.p, self.x = key // (len(self.words) + 1), key % (len(self.words) + 1)
        self.of_pair = np.where(pairs == NONE, 0, np.rint(share(pairs) * self.of_context / (1 - BETA))).astype(np.int64)

    def ask(self, shards: int, pairs: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places of n-grams in order of contexts, context of each) of those whose contexts training texts have."""
        if pairs is None:
            context, word, often, hashes = self.v, self.w, self.of_context, self.hashes
        else:
            context, word, often = self.p, self.x, self.of_pair[self.p]
            with np.errstate(over="ignore"):
                hashes = mix(self.hashes[self.v] * U(0x9E3779B97F4A7C15) + self.hashes[self.w])
        at = np.flatnonzero(often > 0)
        by = mix(hashes)[context[at]]
        hot = often[at] > HOT
        by[hot] = mix(by[hot] ^ mix(self.words[word[at[hot]]] + U(1)))
        shard = (by % U(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        self.prints = hashes >> U(64 - CONTEXT)
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(part):
                yield int(shard[part[0]]), at[part], context[at[part]]

    def questions(self, shards: int, pairs: np.ndarray | None = None) -> list[tuple]:
        if pairs is None:
            which, trained, word, often = self.pair, self.train, self.w, self.of_context
        else:
            which, trained, word, often = self.triple, self.train[self.inner], self.x, self.of_pair[self.p]
        counts = np.bincount(which[trained], minlength=len(word))
        prints, out = self.words >> U(64 - PRINT), []
        for shard, at, context in self.ask(shards, pairs):
            new = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            total = often[at[new]]
            few, which_ = np.unique(word[at], return_inverse=True)
            out.append((shard, self.number, pack_bits(self.prints[context[new]], CONTEXT), pack_planes(np.diff(np.append(new, len(at)))), pack_bits(prints[few], PRINT), pack_planes(which_), pack_planes(counts[at]), pack(np.where(total > HOT, total, 0))))
        return out

    def answered(self, shards: int, answers: dict[int, np.ndarray], pairs: np.ndarray | None = None) -> np.ndarray:
        """Shares of the block's n-grams from what each shard found."""
        out = np.full(len(self.w if pairs is None else self.x), NONE, np.uint16)
        for shard, at, _ in self.ask(shards, pairs):
            out[at] = answers[shard]
        return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def _ask_words(shards: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            b = Block(row)
            shard = (mix(b.words) % U(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(b.tokens[b.train], minlength=len(b.words))
            parts = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)
            yield from _rows([(int(shard[p[0]]), b.number, None, None, pack(b.words[p]), None, pack_planes(counts[p]), None) for p in parts], ASKED).to_batches()

    return run


@lean
def _answer_words(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first level: words and how often each occurs; and of block -1, how many tokens and different words there are."""
    rows = [(r["block"].as_py(), unpack(r["successors"], U), unpack_planes(r["counts"])) for r in _each(parts)]
    u, back = np.unique(np.concatenate([x for _, x, _ in rows]), return_inverse=True)
    n = np.bincount(back, np.concatenate([x for *_, x in rows]), len(u)).astype(np.int64)
    with tempfile.TemporaryFile() as file:
        level = EliasFano(u[n > 0], file)
        at = file.tell()
        file.write(n[n > 0].tobytes())
        file.flush()
        data = np.memmap(file, np.uint8, "r")
    level.open(data)
    counts = data[at:].view(np.int64) if at % 8 == 0 else np.frombuffer(data[at:].tobytes(), np.int64)
    shard = key[0].as_py()
    for block, w, _ in rows:
        found = level.find(w)
        yield from _rows([(shard, block, pack(np.where(found >= 0, counts[np.maximum(found, 0)] if len(counts) else 0, 0).astype(np.int64)), None, None)], ANSWER).to_batches()
    yield from _rows([(shard, -1, None, int(counts.sum()), len(counts))], ANSWER).to_batches()


@lean
def _answer(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's part of a level, built of all questions; what each finds in it."""
    rows = [(r["block"].as_py(), unpack_bits(r["contexts"], CONTEXT), unpack_planes(r["sizes"]), unpack_bits(r["successors"], PRINT)[unpack_planes(r["which"])], unpack_planes(r["counts"]), unpack(r["totals"], np.int64)) for r in _each(parts)]
    v, k, w, n, total = (np.concatenate([r[i] for r in rows]) for i in range(1, 6))
    trie = Trie(v, w, n, total, k)
    found = trie.find(*trie.asked)[trie.which]  # what many blocks ask is looked up once
    at = 0
    for block, _, _, own, *_ in rows:
        yield from _rows([(key[0].as_py(), block, pack(found[at : at + len(own)]), None, None)], ANSWER).to_batches()
        at += len(own)


def _learned(level: int, shards: int):
    """Blocks with what a level answered: counts of their words, or shares of their pairs."""

    @_freed
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows([], BLOCK)
        row = {name: left.column(name)[0] for name in BLOCK}
        b = Block(row)
        answers = dict(zip(right.column("shard").to_pylist(), right.column("found"), strict=True))
        if level == 1:
            counts = np.zeros(len(b.words), np.int64)
            shard = (mix(b.words) % U(shards)).astype(np.int32)
            for s, x in answers.items():
                counts[shard == s] = unpack(x, np.int64)
            new = {"counts": pack(counts)}
        else:
            b.pairs()
            new = {"pairs": pack(b.answered(shards, {s: unpack(x, np.uint16) for s, x in answers.items()}))}
        return _rows([tuple(new[c] if c in new else row[c].as_py() for c in BLOCK)], BLOCK)

    return run


def _ask(level: int, shards: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            b, pairs = Block(row), None
            b.pairs()
            if level == 3:
                pairs = unpack(row["pairs"], np.uint16)
                b.triples(pairs)
            yield from _rows(b.questions(shards, pairs), ASKED).to_batches(max_chunksize=16)

    return run


def _scores(n: int, scale: float, shards: int):
    @_freed
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SCORES.empty_table()
        row = {name: left.column(name)[0] for name in BLOCK}
        b, pairs = Block(row), unpack(row["pairs"], np.uint16)
        b.pairs()
        b.triples(pairs)
        triples = b.answered(shards, {s: unpack(x, np.uint16) for s, x in zip(right.column("shard").to_pylist(), right.column("found"), strict=True)}, pairs)
        one = (b.counts + 0.5) / scale
        of_pair = np.where(b.of_context > 0, share(pairs) + BETA * one[b.w], one[b.w])
        p = of_pair[b.pair]
        of_triple = np.where(b.of_pair[b.p] > 0, share(triples), -1.0)[b.triple]
        p[b.inner] = np.where(of_triple >= 0, of_triple + BETA * p[b.inner], p[b.inner])
        add = lambda x: np.add.reduceat(x[b.tokens], b.first)
        columns = [pa.array(b.ids, mask=b.null), pa.array(b.held), pa.array(b.sizes), pa.array(add((b.counts > 0).astype(np.int64))), pa.array(np.full(len(b.ids), n)), pa.array(add(np.log10(b.counts + 0.5)) - b.sizes * np.log10(scale)), pa.array(np.add.reduceat(np.log10(p), b.first))]
        return pa.Table.from_arrays(columns, schema=SCORES)

    return run


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def language_scores(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``documents``.

    Learns from rows outside the fold that is held out; a null id is never held out.  A null or blank text is its end
    only.  Repeated rows count and are scored each; columns other than ``doc_id`` and ``text`` are ignored.  Without
    training rows every score is that of the smoothed unigram over no words.  An empty table gives an empty table."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held"))
    blocks, blocks_at = stored(docs.mapInArrow(_cut, schema(**BLOCK)), "blocks")
    shards = max(12, -(-int(blocks.agg(F.sum("n")).first()[0] or 0) // SHARD))  # a token ends one n-gram of each level

    def answers_of(level: int) -> tuple[DataFrame, str]:
        asked = blocks.mapInArrow(_ask_words(shards) if level == 1 else _ask(level, shards), schema(**ASKED))
        return stored(asked.groupBy("shard").applyInArrow(_answer_words if level == 1 else _answer, schema(**ANSWER)), "answers")

    for level in (1, 2):
        answers, answers_at = answers_of(level)
        if level == 1:
            n, v = (int(x or 0) for x in answers.agg(F.sum("n"), F.sum("v")).first())
        learned, learned_at = stored(blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(_learned(level, shards), schema(**BLOCK)), "blocks")
        discard(spark, blocks_at, answers_at)
        blocks, blocks_at = learned, learned_at
    answers, _ = answers_of(3)
    fields = schema(doc_id=LONG, held_out=T.BooleanType(), n_tokens=LONG, n_known=LONG, train_tokens=LONG, base_score=DOUBLE, score=DOUBLE)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(n, n + 0.5 * (v + 1), shards), fields)
