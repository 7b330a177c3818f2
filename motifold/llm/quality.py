"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy with
temperature-calibrated probabilities.

A word that the fitting rows hold often has a row of its own, any other word the row of its shape (letters by case,
digits and punctuation, runs shortened); a long word or shape is many pieces, each with the row of its shape.  Every row
has a sparse ternary index vector drawn from a hash of its name; its word vector adds the index vectors of its neighbours
within two words.  A document is the mean of its words' (and pieces') vectors.

Only the fit is bounded (``FIT_ROWS`` labelled rows, chosen by a hash of their ids); every text is scored whole.  The
fitting rows' texts stay on the executors, which count their words, sum up their neighbours (whole numbers, so that no
order of adding shows) and pool them; the driver sees names, sums and one pooled vector a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BINARY, DOUBLE, INT, LONG, STRING, discard, schema, stored, trimmed

#: Labelled rows that the fit uses at most, and the least count of a word that gets a row.
FIT_ROWS, LEAST = 6000, 8
#: Bytes that a model may have: it is sent to all tasks.  Its size follows the fitting rows, not the corpus.
MODEL_BYTES = 1 << 30
#: Neighbours that are summed up at once.
TOGETHER = 250_000
DIM, NONZERO, NEAR, HIDDEN, STEPS = 128, 8, 2, 32, 400
#: A score from which a document counts as good.
GOOD = 0.7
#: Words whose rows an executor remembers.
REMEMBERED = 1 << 18
#: Characters of a word whose shape is taken at once; longer words are not remembered.
PIECE = 48

_SHAPE = [(regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"[\p{L}--A]+", regex.V1), "a"), (regex.compile(r"\p{N}+"), "0"), (regex.compile(r"(.)\1+"), r"\1\1")]
AGAIN = "\x00again"


def shapes(word: str) -> list[str]:
    """Shapes of a word's pieces, which are all of it: of 48 characters at most, then of 8 characters of a shape."""
    out = []
    for lo in range(0, len(word), PIECE):
        piece = word[lo : lo + PIECE]
        for pattern, by in _SHAPE:
            piece = pattern.sub(by, piece)
        out += ("\x00" + piece[i : i + 8] for i in range(0, len(piece), 8))
    return out


def _index(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each name's index vector."""
    at, sign = np.empty((len(names), NONZERO), np.int64), np.empty((len(names), NONZERO), np.float32)
    for i, name in enumerate(names):
        rng = np.random.default_rng(xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")))
        at[i], sign[i] = rng.choice(DIM, NONZERO, replace=False), rng.choice([-1.0, 1.0], NONZERO)
    return at, sign


class Rows(dict):
    """Row of a word; for one of many pieces, -1 less its place in ``many``, which has their rows."""

    def __init__(self, words: list[str], shapes: list[str]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.known, self.shapes, self.other = dict(self), {s: len(words) + i for i, s in enumerate(shapes)}, len(words) + len(shapes)
        self.many: list[list[int]] = []
        self.pieces = 0

    def __missing__(self, word: str) -> int:
        found = [self.shapes.get(s, self.other) for s in shapes(word)]
        row = found[0]
        if len(found) > 1:
            row = -1 - len(self.many)
            self.many.append(found)
            self.pieces += len(found)
        if len(word) <= PIECE:
            self[word] = row
        return row

    def of(self, words: list[str]) -> np.ndarray:
        """Rows of words and pieces, in order."""
        if len(self) + self.pieces > REMEMBERED + len(self.known):
            self.clear()
            self.update(self.known)
            self.many, self.pieces = [], 0
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(rows < 0)
        if not len(at):
            return rows
        found = [self.many[-1 - i] for i in rows[at]]
        sizes = np.ones(len(rows), np.int64)
        sizes[at] = [len(x) for x in found]
        out = np.repeat(rows, sizes)
        out[out < 0] = np.concatenate(found)
        return out


def counted(texts: Iterator[str]) -> dict[str, int]:
    """How often each word occurs, and 0 for each shape of theirs, all of which begin with a null character."""
    counts: dict[str, int] = {}
    for text in texts:
        for w in text.split():
            counts[w] = counts.get(w, 0) + 1
    return {w: n for w, n in counts.items() if w[0] != "\x00"} | {s: 0 for w in counts for s in shapes(w)}


class Names:
    """Which words and shapes have a row, and the index vectors of these."""

    def __init__(self, counts: dict[str, int]):
        self.words = sorted(w for w, n in counts.items() if n >= LEAST)
        self.shapes = sorted(s for s, n in counts.items() if not n)
        self.all = [*self.words, *self.shapes, "\x00other", AGAIN]
        if len(self.all) * DIM * 4 > MODEL_BYTES:
            raise ValueError(f"the fitting rows hold {len(self.all)} names: fit on fewer rows")
        self.at, self.sign = _index(self.all)

    def rows(self) -> Rows:
        return Rows(self.words, self.shapes)

    def near(self, texts: Iterator[str]) -> np.ndarray:
        """Sum of the index vectors of each row's neighbours, in whole numbers."""
        rows, out = self.rows(), np.zeros(len(self.all) * DIM, np.int64)
        left, right, held = [], [], 0

        def add():
            x, y = np.concatenate(left), np.concatenate(right)
            for lo in range(0, len(x), TOGETHER):
                p, q = x[lo : lo + TOGETHER], y[lo : lo + TOGETHER]
                np.add(out, np.bincount((p[:, None] * DIM + self.at[q]).ravel(), self.sign[q].ravel(), len(out)).astype(np.int64), out)

        for text in texts:
            r = rows.of(text.split())
            for k in range(1, NEAR + 1):
                left += (r[:-k], r[k:])
                right += (r[k:], r[:-k])
                held += 2 * len(r)
            if held > TOGETHER:
                add()
                left, right, held = [], [], 0
        if held:
            add()
        return out.reshape(-1, DIM)


def unit(near: np.ndarray) -> np.ndarray:
    """Sums of neighbours at length one."""
    return (near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Model:
    """Word vectors (from sums of neighbours, or these at length one), and the network once ``fitted``."""

    def __init__(self, names: Names, near: np.ndarray):
        self.words, self.shapes, self._rows = names.words, names.shapes, None
        base = np.zeros((len(names.all), DIM), np.float32)
        np.put_along_axis(base, names.at, names.sign, 1)
        rows = names.rows()
        for i, w in enumerate(self.words):  # a word with a row also has its shape's vector, the mean of its pieces'
            base[i] += base[[rows.shapes[s] for s in shapes(w)]].mean(0)
        base += near if near.dtype == np.float32 else unit(near)
        self.vectors = base
        self.fitted(np.zeros((0, DIM + 1)), np.zeros(0))

    def fitted(self, pooled: np.ndarray, labels: np.ndarray) -> Model:
        self._fit(pooled, labels.astype(np.float32))
        return self

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(DIM + 1, np.float32), np.ones(DIM + 1, np.float32))
        z = (x - self.mean) / self.scale
        held = np.arange(len(y)) % 5 == 4  # these rows set the temperature
        self.w = [rng.normal(0, 1 / np.sqrt(DIM), (DIM + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        if not len(y):
            return
        a, b = z[~held], y[~held]
        first, second = ([np.zeros_like(w) for w in self.w] for _ in range(2))
        for t in range(1, STEPS + 1):
            hidden = np.tanh(a @ self.w[0] + self.w[1])
            d = (1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -30, 30))) - b) / max(1, len(b))
            back = np.outer(d, self.w[2]) * (1 - hidden**2)
            for i, g in enumerate([a.T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ d + 1e-4 * self.w[2], d.sum(keepdims=True)]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.w[i] = self.w[i] - 0.02 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        if held.any():
            logit, target = self._logit(z[held]), y[held]
            tried = np.geomspace(0.25, 8, 41)
            loss = [np.mean(np.logaddexp(0, np.where(target > 0, -1, 1) * logit / t)) for t in tried]
            self.temperature = float(tried[int(np.argmin(loss))])

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def pooled(self, text: str) -> np.ndarray:
        """Mean word vector, and the share of words that repeat the word before."""
        words = text.split()
        out = np.zeros(DIM + 1, np.float32)
        if not words:
            return out
        rows = self._rows or self._start()
        r = rows.of(words)
        u, n = np.unique(r.astype(np.int32), return_counts=True)
        again = sum(map(str.__eq__, words, words[1:]))
        out[:DIM] = (n.astype(np.float32) @ self.vectors[u] + again * self.vectors[-1]) / len(r)
        out[DIM] = again / len(words)
        return out

    def _start(self) -> Rows:
        self._rows = Rows(self.words, self.shapes)
        return self._rows

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = (np.stack([self.pooled(t or "") for t in texts]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self._logit(z) / self.temperature, -30, 30)))


def held_out(col: str = "doc_id") -> F.Column:
    """Rows that no fit may see."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows outside the fold that is held out.

    Rows without an id, or a label other than 0 and 1, are left out; of several labels of one id the largest counts."""
    spark = documents.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    chosen = spark.createDataFrame(few, "doc_id long, quality int")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample, sample_at = stored(texts.join(F.broadcast(chosen), "doc_id"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counted(x for batch in batches for x in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"name": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    counts = sample.select("text").mapInArrow(count, schema(name=STRING, n=LONG)).groupBy("name").agg(F.sum("n").alias("n")).where((F.col("n") == 0) | (F.col("n") >= LEAST)).toArrow()
    names = Names(dict(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True)))
    sent = spark.sparkContext.broadcast(names)  # at most MODEL_BYTES

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value.near(x for batch in batches for x in batch.column(0).to_pylist())
        at = np.flatnonzero(found.any(1))
        for lo in range(0, len(at), 2000):
            yield pa.RecordBatch.from_pydict({"row": pa.array(at[lo : lo + 2000].astype(np.int32)), "sums": pa.array([x.astype(np.int32).tobytes() for x in found[at[lo : lo + 2000]]], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for row, x in zip(part.column("row").to_pylist(), part.column("sums"), strict=True):
                sums[row] = sums.get(row, 0) + np.frombuffer(x.as_buffer(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"row": pa.array(sums.keys(), pa.int32()), "sums": pa.array([x.tobytes() for x in unit(np.stack(list(sums.values())))], pa.binary())})

    out = np.zeros((len(names.all), DIM), np.float32)
    # as large as the model
    found = sample.select("text").mapInArrow(near, schema(row=INT, sums=BINARY)).groupBy((F.col("row") % 64).alias("part")).applyInArrow(add, schema(row=INT, sums=BINARY)).toArrow()
    for part in found.to_batches():
        out[np.asarray(part.column(0))] = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float32).reshape(-1, DIM)
    sent.destroy()  # the driver's copy too
    del found, counts
    model = Model(names, out)
    del out
    with_vectors = spark.sparkContext.broadcast(model)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "quality": batch.column(2), "pooled": pa.array([with_vectors.value.pooled(x).tobytes() for x in batch.column(1).to_pylist()], pa.binary())})

    pooled = sorted(sample.select("doc_id", "text", "quality").mapInArrow(pool, schema(doc_id=LONG, quality=INT, pooled=BINARY)).collect(), key=lambda r: (r[0], bytes(r[2])))
    with_vectors.destroy()
    discard(spark, sample_at)
    trimmed(spark)
    return model.fitted(np.frombuffer(b"".join(bytes(r[2]) for r in pooled), np.float32).reshape(-1, DIM + 1), np.array([r[1] for r in pooled], np.float32))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and blank texts get the score of a document without words.  Repeated rows each get a row; a null id is never
    held out.  Columns other than ``doc_id`` and ``text`` are ignored."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64())})

    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema(doc_id=LONG, score=DOUBLE))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns as they are, that the classifier doesn't reject."""
    shared, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at).to_pylist()) >= GOOD, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
