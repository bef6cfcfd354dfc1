"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Every word has a sparse random index vector drawn from its hash. A word's vector is the sum of the index vectors of the words beside it
over all documents, damped by the square root of its length; words share ``BUCKETS`` rows by hash, so the table has a fixed size whatever the
corpus. A document is the mean and the spread of its words' vectors and of their index vectors. A word counts together with its shape: words
that repeat the last one, are all capitals or carry symbols have vectors of their own. The network is plain numpy; a
temperature fitted on rows it did not learn from calibrates its probabilities.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import chunks, mix, some_rows, words

BUCKETS = 1 << 13
DIM = 32
MARKS = 3          # non-zero entries of an index vector
BLOCKS = 64        # rows in which a task hands over its sums
MAX_TRAIN_ROWS = 20_000
HIDDEN = 24

_SHAPE = np.zeros(256, dtype=np.uint8)   # bit 1: capital, 2: small letter, 4: symbol, 8: digit
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58] = 1, 2, 8
_SHAPE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_PLAIN = np.isin(np.arange(256), [ord(c) for c in ".,;:'-?"])


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape bucket of each word, and the place of each row's first word."""
    hashes, begins, ends, first = words(data, offsets)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    marks = _SHAPE[data]
    odd = np.concatenate([[0], np.cumsum((marks == 4) & ~_PLAIN[data])])
    capitals = np.concatenate([[0], np.cumsum(marks == 1)])
    small = np.concatenate([[0], np.cumsum((marks == 2) | (data >= 128))])
    odd, capitals, small = odd[ends] - odd[begins], capitals[ends] - capitals[begins], small[ends] - small[begins]
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(hashes)]] = False
    shape = (again * 1 + (capitals > 1) * (small == 0) * 2 + np.minimum(odd, 3) * 4 + ((ends - begins) == odd) * 16
             + np.minimum((ends - begins) // 12, 3) * 32)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), shape.astype(np.int64), first


SHAPES = 128


@lru_cache(1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the marks of each bucket's index vector; shapes follow the words."""
    h = mix(np.arange((BUCKETS + SHAPES) * MARKS, dtype=np.uint64) + np.uint64(0x5EED))
    return (h % np.uint64(DIM)).astype(np.int64).reshape(-1, MARKS), np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32).reshape(-1, MARKS)


@lru_cache(1)
def _dense() -> np.ndarray:
    places, signs = index_vectors()
    out = np.zeros((BUCKETS + SHAPES, DIM), np.float32)
    for k in range(MARKS):
        np.add.at(out, (np.arange(len(out)), places[:, k]), signs[:, k])
    return out


def _contexts(batches):
    """One task's sums: for each bucket the index vectors of the words before and after it, in ``BLOCKS`` rows."""
    sums = np.zeros(BUCKETS * DIM)
    places, signs = index_vectors()
    seen = False
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            bucket, shape, first = _buckets(data, offsets)
            if len(bucket) < 2:
                continue
            seen = True
            inside = np.ones(len(bucket) - 1, dtype=bool)
            cuts = first[1:-1]
            inside[cuts[(cuts > 0) & (cuts < len(bucket))] - 1] = False
            left, right = bucket[:-1][inside], bucket[1:][inside]
            marked = shape[1:][inside] + BUCKETS
            for here, beside in ((left, right), (right, left), (right, marked)):
                for k in range(MARKS):
                    sums += np.bincount(here * DIM + places[beside, k], weights=signs[beside, k], minlength=BUCKETS * DIM)
    if seen:
        per = BUCKETS // BLOCKS * DIM
        used = [b for b in range(BLOCKS) if sums[b * per:(b + 1) * per].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([sums[b * per:(b + 1) * per].astype(np.float32).tobytes() for b in used], pa.binary())],
                                         names=["block", "sums"])


def _added(key, table):
    total = np.zeros(BUCKETS // BLOCKS * DIM)
    for value in table.column("sums"):
        total += np.frombuffer(value.as_buffer(), np.float32)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The vectors of all buckets, from every document: BUCKETS x DIM, damped to unit-like length.

    Each task hands over its own sums once (at most BUCKETS x DIM numbers); they are added block by block, whole numbers in floats, so the order does not matter
    until a sum passes 2**24. Only the final table, of fixed size, comes to the driver.
    """
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_contexts, "block int, sums binary")
    rows = parts.groupBy("block").applyInArrow(_added, "block int, sums binary").collect()
    out = np.zeros((BLOCKS, BUCKETS // BLOCKS * DIM), np.float32)
    for row in rows:
        out[row["block"]] = np.frombuffer(row["sums"], np.float32)
    out = out.reshape(BUCKETS, DIM)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.sqrt(np.maximum(length, 1.0)) / 4).astype(np.float32)


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its words' vectors, mean of the index vectors of their shapes, and the log length."""
    index = _dense()
    out = []
    for _, _, data, offsets in chunks(column):
        bucket, shape, first = _buckets(data, offsets)
        n = np.diff(first)
        rows = np.zeros((len(n), 3 * DIM + 1), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            starts, count = first[:-1][full], n[full, None].astype(np.float32)
            v = vectors[bucket]
            mean = np.add.reduceat(v, starts, axis=0) / count
            rows[full, :DIM] = mean
            rows[full, DIM:2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, starts, axis=0) / count - mean * mean, 0))
            rows[full, 2 * DIM:3 * DIM] = np.add.reduceat(index[BUCKETS + shape], starts, axis=0) / count
            rows[full, -1] = np.log1p(count[:, 0])
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, 3 * DIM + 1), np.float32)


class Network:
    """Two layers: tanh units and a logistic output, on standardised inputs, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, seed: int = 5, epochs: int = 60, decay: float = 2e-4):
        random = np.random.default_rng(seed)
        self.rate = float((y.sum() + 1) / (len(y) + 2))
        self.single = len(np.unique(y)) < 2
        self.centre, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        x = (x - self.centre) / self.scale
        self.w1, self.b1 = random.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden)
        self.w2, self.b2, self.temperature = random.normal(0, hidden ** -0.5, hidden), 0.0, 1.0
        if self.single:
            return
        order = random.permutation(len(x))
        held, learn = order[:len(x) // 10], order[len(x) // 10:]
        moments = [[np.zeros_like(np.asarray(p, float)), np.zeros_like(np.asarray(p, float))] for p in (self.w1, self.b1, self.w2, self.b2)]
        step, best = 0, (np.inf, None)
        for epoch in range(epochs):
            random.shuffle(learn)
            for low in range(0, len(learn), 64):
                some = learn[low:low + 64]
                h = np.tanh(x[some] @ self.w1 + self.b1)
                error = (1 / (1 + np.exp(-(h @ self.w2 + self.b2))) - y[some]) / len(some)
                back = np.outer(error, self.w2) * (1 - h * h)
                grads = (x[some].T @ back + decay * self.w1, back.sum(0), h.T @ error + decay * self.w2, error.sum())
                step += 1
                new = []
                for p, g, m in zip((self.w1, self.b1, self.w2, self.b2), grads, moments, strict=True):
                    m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                    new.append(p - 0.004 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8))
                self.w1, self.b1, self.w2, self.b2 = new
            if len(held):
                loss = self._loss(self._logit(x[held]), y[held])
                if loss < best[0]:
                    best = (loss, [p.copy() if hasattr(p, "copy") else p for p in (self.w1, self.b1, self.w2, self.b2)])
        if best[1] is not None:
            self.w1, self.b1, self.w2, self.b2 = best[1]
            logit = self._logit(x[held])
            grid = np.exp(np.linspace(np.log(0.5), np.log(4), 41))
            self.temperature = float(grid[np.argmin([self._loss(logit / t, y[held]) for t in grid])])

    @staticmethod
    def _loss(logit, y):
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    def _logit(self, x):
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.single:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.centre) / self.scale) / self.temperature, -30, 30)))


def _id_text(docs, doc_id, text):
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, doc_id: str, text: str, label: str, max_rows: int = MAX_TRAIN_ROWS) -> Network:
    """The network, from about ``max_rows`` labelled rows at most, chosen by the hash of their id; null labels and ids are left out."""
    def featured(batches):
        for batch in batches:
            x = pooled(batch.column("text"), vectors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])
    given = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    chosen = F.broadcast(some_rows(given, "doc_id", max_rows, given.count()))
    some = _id_text(docs, doc_id, text).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = some.mapInArrow(featured, "doc_id long, x binary").join(chosen, "doc_id").orderBy("doc_id", "y").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], dtype=np.float64).reshape(-1, 3 * DIM + 1)
    return Network(x, np.array([r["y"] for r in rows], dtype=np.float64))


def quality(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
            threshold: float = 0.5) -> DataFrame:
    """doc_id, score (probability of label 1), predicted of every row of ``docs``.

    The network learns from ``labels`` (texts from ``learn``, by default ``docs``); word vectors come from every text of ``learn``. Null and empty texts
    have a zero vector and its score. Repeated rows get equal scores; null ids are scored and teach nothing. With one label only, or none, the
    score is the smoothed share of ones. An empty table gives an empty table; other columns are not read.
    """
    learn = docs if learn is None else learn
    vectors = word_vectors(learn, text)
    network = train(learn, labels, vectors, doc_id, text, label)

    def run(batches):
        for batch in batches:
            p = network.probability(pooled(batch.column("text"), vectors))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    return _id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
              threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns, in one pass without a join."""
    learn = docs if learn is None else learn
    vectors = word_vectors(learn, text)
    network = train(learn, labels, vectors, doc_id, text, label)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(network.probability(pooled(batch.column(text), vectors)) >= threshold, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
