"""Quality classifier: random-indexing word vectors, pooled, under a small calibrated network.

Every token hashes to a row of a fixed table.  A row's index vector is a sparse
random ternary one; its word vector is the sum of the index vectors around its
occurrences (and its own), scaled to unit length, added up by Spark over the
training sample.  A document is pooled to the mean and spread of its tokens'
vectors and its log length.  A two-layer network in numpy is fitted on the
pooled rows of a bounded labelled sample (``per_class`` rows of each label, by a
seeded hash), and one temperature and offset are fitted on a held part of it,
weighted back to the labels' natural shares.  Whole texts are pooled.

Null, empty and blank texts pool to zeros and get a score like any other.
Labels other than 0 and 1 and null labels are ignored; a document labelled
twice counts with its smaller label.  With no labels, or one label alone, the
score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.llm.common import give_back, mix64, pieces_of, slices, stash

ROWS, DIMS, NONZERO, WINDOW = 1 << 15, 48, 4, 2
PER_CLASS, HIDDEN, EPOCHS, SEED, LEAST_HELD = 3000, 24, 60, 13, 5
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Codes(dict):
    """Row of a token in the table, remembered; emptied when it grows past ``limit`` and after a task."""

    limit = 200_000

    def __missing__(self, token: str) -> int:
        if len(self) > self.limit:
            self.clear()
        row = self[token] = crc32(token.encode("utf-8", "replace")) % ROWS
        return row


_CODES = Codes()


def forget_codes() -> None:
    """A worker lives on for other stages: it keeps no table."""
    _CODES.clear()
    give_back()


def token_rows(text: str | None) -> np.ndarray:
    """Table rows of a text's tokens: runs of letters, of digits, of other signs."""
    tokens = TOKEN.findall(text) if text else []
    return np.fromiter(map(_CODES.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> np.ndarray:
    """The sparse ternary index vector of every row, from the seed alone."""
    out = np.zeros((ROWS, DIMS), np.float32)
    for k in range(NONZERO):
        x = mix64(np.arange(ROWS, dtype=np.uint64) * np.uint64(NONZERO) + np.uint64(k + 1))
        np.add.at(out, (np.arange(ROWS), (x % np.uint64(DIMS)).astype(np.int64)), np.where(x >> np.uint64(63), 1, -1))
    return out


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit word vectors (rows x dims): index vectors summed around every occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((ROWS, DIMS))
        for batch in batches:
            for t in batch.column(0):
                rows = token_rows(t.as_py())
                if not len(rows):
                    continue
                v = index[rows]
                around = v.copy()
                for d in range(1, min(WINDOW, len(rows) - 1) + 1):
                    around[d:] += v[:-d]
                    around[:-d] += v[d:]
                order = np.argsort(rows, kind="stable")
                at = np.flatnonzero(np.diff(rows[order], prepend=-1))
                total[rows[order[at]]] += np.add.reduceat(around[order], at, axis=0)
        forget_codes()
        used = np.flatnonzero(total.any(axis=1))
        for a in range(0, len(used), 4096):
            part = used[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(total[part].ravel()), DIMS).cast(pa.list_(pa.float64()))], names=["row", "sums"])

    sums = texts.mapInArrow(run, "row long, sums array<double>").groupBy("row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(DIMS)]).alias("sums"))
    out = np.zeros((ROWS, DIMS), np.float32)
    for row, vector in sums.collect():  # at most ROWS rows
        out[row] = vector
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the tokens' vectors and the log length of each text."""
    out = np.zeros((len(texts), 2 * DIMS + 1), np.float32)
    for i, t in enumerate(texts):
        rows = token_rows(t)
        if not len(rows):
            continue
        total, square = np.zeros(DIMS), np.zeros(DIMS)
        for a in range(0, len(rows), 8192):
            v = vectors[rows[a : a + 8192]]
            total += v.sum(axis=0)
            square += np.einsum("ij,ij->j", v, v)
        mean = total / len(rows)
        out[i] = np.r_[mean, np.sqrt(np.maximum(square / len(rows) - mean**2, 0)), np.log1p(len(rows))]
    return out


@dataclass
class Network:
    """Two layers over standardised pooled rows; ``prior`` alone where nothing could be fitted."""

    prior: float
    vectors: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple = ()
    slope: float = 1.0
    offset: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-(self.slope * self.logits(pooled(texts, self.vectors)).astype(float) + self.offset)))


def train_layers(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> tuple:
    """Adam on the weighted log loss, in small batches."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 64):
            at = order[a : a + 64]
            h = np.tanh(x[at] @ w[0] + w[1])
            e = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[at]) * weight[at] / len(at)
            back = np.outer(e, w[2]) * (1 - h**2)
            grads = [x[at].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ e + 1e-4 * w[2], e.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g**2
                w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Temperature and offset that minimise the weighted log loss (a grid of temperatures, Newton for the offset)."""
    best = (np.inf, 1.0, 0.0)
    for slope in 2.0 ** np.linspace(-4, 2, 49):
        offset = 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(slope * z + offset)))
            offset -= np.clip(((p - y) * weight).sum() / ((p * (1 - p) * weight).sum() + 1e-6), -2, 2)
        p = np.clip(1 / (1 + np.exp(-(slope * z + offset))), 1e-9, 1 - 1e-9)
        best = min(best, (float(-((y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).sum()), float(slope), float(offset)))
    return best[1], best[2]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, seed: int = SEED) -> Network:
    """Fit on a sample of at most ``per_class`` rows of each label; ``labels`` holds training rows only.

    A fifth of each label is held back for calibration.  A label with fewer than ``LEAST_HELD`` rows
    keeps all for training, and then all rows calibrate."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("y"))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    zeros, ones = shares.get(0, 0), shares.get(1, 0)
    prior = (ones + 1) / (zeros + ones + 2)
    if not zeros or not ones:
        return Network(prior)
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(picks[0].union(picks[1]))  # 2 * per_class rows at most
    sample = stash(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "_id").repartition(6, "_id"))
    vectors = word_vectors(sample.select("text"))
    spread = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1).to_pylist(), spread.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["i", "y", "x"])

    got = sorted((r["i"], r["y"], bytes(r["x"])) for r in sample.select(F.xxhash64("_id").alias("i"), "text", "y").mapInArrow(run, "i long, y int, x binary").collect())
    if len({g[1] for g in got}) < 2:
        return Network(prior)
    x = np.frombuffer(b"".join(g[2] for g in got), np.float32).reshape(len(got), -1).astype(float)
    y = np.array([g[1] for g in got], float)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        if len(own) >= LEAST_HELD:
            held[own[::5]] = True
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    even = np.where(y == 1, 0.5 / max(y[~held].mean(), 1e-9), 0.5 / max(1 - y[~held].mean(), 1e-9))
    net = Network(prior, vectors, mean.astype(np.float32), scale.astype(np.float32), train_layers(z[~held], y[~held], even[~held], seed))
    natural = np.where(y == 1, ones / (y == 1).sum(), zeros / (y == 0).sum())
    if len(set(y[held])) < 2:  # too few rows of a class to hold any back
        held[:] = True
    net.slope, net.offset = calibrate(net.logits(x[held]), y[held], natural[held] / natural[held].mean())
    return net


def classify(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1 of each whole text."""
    told = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            col = batch.column(at)
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in col.cast(pa.binary())], np.int64)
            for a, b in pieces_of(sizes):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(told.value.scores(col.slice(a, b - a).to_pylist()))], names=[*batch.schema.names, "score"])
        forget_codes()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double")
