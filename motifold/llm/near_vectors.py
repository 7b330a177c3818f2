"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets and verified
candidates.

A rotation is three rounds of random signs and a fast Hadamard transform; its code is the largest coordinate by absolute
value, with its sign.  A table strings as many codes together as keep unrelated vectors in a bucket few, and each vector
stands in the buckets of its best ``PROBES`` codes.  Equal vectors are one class and hashed once.  A bucket is cut into
tiles; a pair of tiles is one matrix product in double precision, so no task holds a large bucket whole.  A pair counts
in the first bucket that both share, hence once, and what leaves a tile pair is sums and a spanning forest, not pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BINARY, LONG, discard, schema, stored

PROBES = 2
#: Vectors of a tile, about; unrelated vectors that a bucket may hold, about.
TILE, CROWD = 1024, 1024
#: Type of nodes: ids, and above them numbers of classes without any.
NODE, NODE_ARROW = "decimal(20,0)", pa.decimal128(20, 0)


def tables(length: int) -> int:
    """How many tables: the more codes a bucket strings together, the rarer near vectors share one.

    Of pairs at a cosine of 0.95 these find, measured in 32 to 128 dimensions, 0.99 and more up to three codes."""
    return 2 + 2 * length


def _rotate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], x.shape[1])
        h = 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
            h *= 2
        x = x / math.sqrt(x.shape[1])
    return x


def codes(x: np.ndarray, length: int) -> np.ndarray:
    """Bucket of each of n vectors in each table, for each probe: n * tables * PROBES."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.concatenate([x, np.zeros((n, width - d))], 1)
    out = np.zeros((n, tables(length), PROBES), np.int64)
    for t in range(out.shape[1]):
        best, second, loss = [], [], []
        for k in range(length):
            y = _rotate(x, np.random.default_rng((t, k, d)))
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            v = np.take_along_axis(y, top, 1)
            swap = np.abs(v[:, 0]) < np.abs(v[:, 1])
            top[swap], v[swap] = top[swap][:, ::-1], v[swap][:, ::-1]
            code = top * 2 + (v < 0)
            best.append(code[:, 0])
            second.append(code[:, 1])
            loss.append(np.abs(v[:, 0]) - np.abs(v[:, 1]))
        change = np.argmin(loss, axis=0)  # the probe takes the second code where that costs least
        for p in range(PROBES):
            h = np.full(n, d, np.int64)
            for k in range(length):
                c = best[k] if p == 0 else np.where(change == k, second[k], best[k])
                h = h * (2 * width + 1) + c
            out[:, t, p] = h
    return out


def _valid(v: np.ndarray | None) -> bool:
    return v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool((v != 0).any())


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Doubles of each row; null where a row or one of its components is null."""
    flat, at = column.values, np.asarray(column.offsets)
    null, values = np.asarray(flat.is_null()), np.asarray(flat.cast(pa.float64()).fill_null(0.0))
    valid = np.asarray(column.is_valid())
    return [values[a:b] if ok and not null[a:b].any() else None for a, b, ok in zip(at[:-1], at[1:], valid, strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True)  # else squares of large components overflow
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def packed(v: np.ndarray) -> bytes:
    """A vector's numbers, in single precision where that loses nothing, behind a byte that says which."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return b"\x04" + single.tobytes() if (single == v).all() else b"\x08" + v.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.float32 if x[0] == 4 else np.float64, offset=1).astype(np.float64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [v if _valid(v) else None for v in _vectors(batch.column(1))]
        sig = [None if v is None else xxhash.xxh3_128_digest((v + 0.0).tobytes()) for v in got]
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "sig": pa.array(sig, pa.binary()), "vector": pa.array([None if v is None else packed(v) for v in got], pa.binary())})


def _hashed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [unpacked(v) for v in batch.column(3).to_pylist()]
            found: list = [None] * len(vectors)
            for d in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                for i, c in zip(at, codes(_unit(np.stack([vectors[i] for i in at])), length), strict=True):
                    found[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in found], pa.binary()), pa.array([c.ravel().tolist() for c in found], pa.list_(pa.int64()))], names=["sig", "node", "k", "vector", "codes", "buckets"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vectors the smallest that links (a, b) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(least: float):
    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bucket, i, j = (k.as_py() for k in key)
        rows = sorted((r for batch in parts for r in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True)), key=lambda r: (r[0], r[1]))
        tile, sig, node, k, vector, code = zip(*rows, strict=True)
        tile, k = np.array(tile), np.array(k)
        x = _unit(np.stack([unpacked(v) for v in vector]))
        c = np.stack([np.frombuffer(v, np.int64).reshape(-1, PROBES) for v in code])
        left, right = (np.flatnonzero(tile == t) for t in (i, j))
        g = x[left] @ x[right].T >= least
        if i == j:
            g = np.triu(g, 1)
        a, b = np.nonzero(g)
        a, b = left[a], right[b]
        first = np.ones(len(a), bool)
        for lo in range(0, len(a), 200_000):
            p, q = c[a[lo : lo + 200_000]], c[b[lo : lo + 200_000]]
            same = p[:, :, :, None] == q[:, :, None, :]
            earlier = same[:, :table].any((1, 2, 3))
            least_code = np.where(same[:, table].any(2), p[:, table], np.iinfo(np.int64).max).min(1)
            first[lo : lo + 200_000] = ~earlier & (least_code == bucket)
        a, b = a[first], b[first]
        if not len(a):
            return
        links = np.bincount(a, k[b], len(tile)) + np.bincount(b, k[a], len(tile))
        root = _forest(a, b, len(tile))
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_pydict({"sig": pa.array([sig[m] for m in at], pa.binary()), "links": pa.array(links[at].astype(np.int64)), "a": pa.array([node[m] for m in at], NODE_ARROW), "b": pa.array([node[root[m]] for m in at], NODE_ARROW)})

    return run


def near_vectors(embeddings: DataFrame, least: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``embeddings`` (columns ``vec_id, embedding``).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length.  Repeated rows each count as vectors; rows that share a vec_id are one node of components.  A row
    without a vec_id counts as a link of others, and links reach on through it; its own component is null and it isn't
    kept.  Other columns, labels too, are ignored; an empty table gives an empty table."""
    rows, _ = stored(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_signatures, schema(vec_id=LONG, sig=BINARY, vector=BINARY)), "vectors")
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("k"), F.first("vector").alias("vector"))
    # a class without an id is a node above all ids
    node = F.coalesce(F.col("rep").cast(NODE), F.lit(str(1 << 63)).cast(NODE) + F.monotonically_increasing_id().cast(NODE)).cast(NODE)
    classes, _ = stored(classes.select("sig", node.alias("node"), "k", "vector"), "classes")
    n, size = classes.agg(F.count("*"), F.max(F.length("vector"))).first()
    width = 2 << max(1, ((size or 9) // 4 - 1).bit_length())
    length = max(1, math.ceil(math.log(max(1, n / CROWD)) / math.log(width)))
    hashed, hashed_at = stored(classes.mapInArrow(_hashed(length), f"sig binary, node {NODE}, k long, vector binary, codes binary, buckets array<long>"), "hashed")
    placed = hashed.select("sig", "node", "k", "vector", "codes", F.posexplode("buckets").alias("at", "bucket")).withColumn("table", F.floor(F.col("at") / PROBES).cast("int"))
    count = placed.groupBy("table", "bucket").agg(F.count("*").alias("held")).where("held > 1").withColumn("tiles", F.ceil(F.col("held") / TILE).cast("int"))
    placed = placed.join(count, ["table", "bucket"]).withColumn("tile", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("table", "bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "sig", "node", "k", "vector", "codes")
    found, _ = stored(placed.groupBy("table", "bucket", "i", "j").applyInArrow(_verified(least), f"sig binary, links long, a {NODE}, b {NODE}"), "links")
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    one_id = rows.where("vec_id is not null").join(classes.select("sig", "node"), "sig").groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    label, _ = components(found.select("a", "b").union(one_id))
    of_class = classes.select("sig", "node", "k").join(links, "sig", "left").join(label, "node", "left")
    of_class = of_class.select("sig", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.select("vec_id", "sig").join(of_class, "sig", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce(F.col("component").cast("long"), F.col("vec_id")))
    discard(embeddings.sparkSession, hashed_at)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
