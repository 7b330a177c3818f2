"""Words and word shingles of whole Arrow columns as 64-bit hashes, without a Python step for each word.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A word's hash is a polynomial over its bytes, taken from
prefix sums modulo 2^64 (the multiplier is odd, so it has an inverse), then mixed.  Text is worked on in blocks that
end between words, so memory doesn't grow with a text's length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that prefix sums run over, and bytes of texts that are taken together.
BLOCK, PIECE = 1 << 18, 1 << 22
U = np.uint64
_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_SPACE = np.isin(_BYTE, np.array([32, 9, 10, 11, 12, 13], np.uint8))
_ODD = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_MULT = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) | U(1)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        size = max(n, BLOCK + 4096)
        for key, x in (("p", _ODD), ("i", pow(_ODD, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _pow[key] = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, x, U))])
    return _pow["p"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread what differs between two hashes over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
        h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
        return h ^ (h >> U(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins (and the last ends).  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of whole texts, of about PIECE bytes, so that what is worked out for each byte stays small."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + PIECE, "right")) - 1)
        yield column.slice(at, to - at)
        at = to


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words the texts before each text have (a row more than texts)."""
    hashes, at, base = [np.zeros(0, U)], [np.zeros(1, np.int64)], 0
    for part in pieces(column):
        h, ends = _words(part)
        hashes.append(h)
        at.append(ends[1:] + base)
        base += len(h)
    return np.concatenate(hashes), np.concatenate(at)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_bytes(column)
    space = _SPACE[data]
    start = ~space
    ends = start.copy()
    first = off[:-1][off[:-1] < len(data)]
    if len(data):
        keep = np.zeros(len(data), bool)
        keep[first] = True
        start[1:] &= space[:-1] | keep[1:]
        ends[:-1] &= space[1:] | keep[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(ends) + 1
    out = np.empty(len(s), U)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + BLOCK, "right")))
        lo, hi = s[at], e[to - 1]
        p, inv = _powers(hi - lo)
        with np.errstate(over="ignore"):
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(_VALUE[_LOWER[data[lo:hi]]] * p[: hi - lo], out=sums[1:])
            out[at:to] = (sums[e[at:to] - lo] - sums[s[at:to] - lo]) * inv[s[at:to] - lo]
        at = to
    return mix(out), np.searchsorted(s, off)


def spans(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order."""
    for part in pieces(column):
        h, at = _words(part)
        for i in range(len(at) - 1):
            yield h[at[i] : at[i + 1]]


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of its whole sequence if it has fewer words; none without."""
    if not len(h):
        return h
    return np.unique(ordered(h, k))


def ordered(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of a text's shingles in order of position."""
    k = min(k, len(h))
    if not k:
        return h
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1] * _MULT[0] + _MULT[k]
        for j in range(1, k):
            out = (out ^ (out >> U(29))) * _MULT[j + 8] + h[j : len(h) - k + 1 + j]
    return mix(out)
