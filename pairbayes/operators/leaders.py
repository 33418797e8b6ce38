"""Divergence of rows within a class (J10) and greedy leaders by rounds.

The divergence of two rows is the mean over feature pairs of the length of their
difference in the two features, divided by the largest one of the class.  Greedy leaders
are found by walking the rows in id order: a row that no earlier leader lies within the
limit of is a leader, and the first row within the limit of it is selected for it.

No distance matrix is made.  The divergence before division is a norm, so it has a
triangle inequality, and it lies between w/sqrt(2) and w, w the feature differences
weighted by the share of pairs a feature is in; pairs that these bounds decide are not
computed.

* Diameter: a pair further apart than a known one has both rows further from the class's
  mean than that length less the largest distance from the mean.  Only such rows meet, in
  blocks whose boxes allow a larger length.
* Leaders: a round takes the ``prefix`` smallest open ids of each class.  All smaller ids
  are decided, so walking just those rows in one task gives the leaders among them that a
  walk over the whole class gives.  Everything within the limit of them is then closed, in
  parallel, and at least the prefix is.  The rows are kept as chunks (``chunks.py``), so
  a round hands tasks arrays.  The result is the same at any partitioning and
  prefix, and the rounds are at most rows / prefix; rows spread over fewer than
  ``prefix`` places within the limit of each other take one or two."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.functions.columns import MISSING_SENTINEL
from pairbayes.operators import chunks
from pairbayes.operators.dense import unrank_pairs
from pairbayes.session import cut_lineage

# Fixed values of the selection rule: the limit, and what is added to the largest divergence.
MIN_DIVERGENCE = 0.1
MAX_EPS = 1e-7

#: Bytes of the leaders that one round sends to every task.
ROUND_BYTES = 8 << 20
FAR_BLOCK = 1024
#: Leaders that rows meet at once before those that are near one drop out.
CLOSERS = 4


class PairNorm:
    """Mean over feature pairs of the two features' length."""

    def __init__(self, n_features: int, pairs: Sequence[tuple[int, int]] | None = None):
        if pairs is None:
            total = n_features * (n_features - 1) // 2
            self.i, self.j = unrank_pairs(np.arange(total), n_features)
        else:
            self.i, self.j = np.array(list(pairs), np.int64).reshape(-1, 2).T
        if not len(self.i):
            raise ValueError("a divergence needs a pair of features")
        self.weight = (np.bincount(self.i, minlength=n_features) + np.bincount(self.j, minlength=n_features)) / len(self.i)

    def length(self, d: np.ndarray) -> np.ndarray:
        """Norm of difference rows, in slices of bounded size."""
        out = np.empty(len(d))
        step = max(1, (1 << 21) // len(self.i))
        for a in range(0, len(d), step):
            part = d[a : a + step]
            out[a : a + step] = np.sqrt(part[:, self.i] ** 2 + part[:, self.j] ** 2).mean(axis=1)
        return out

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Upper bound for all rows of a and b; 1/sqrt(2) of it is a lower one."""
        return (np.abs(a[:, None, :] - b[None, :, :]) * self.weight).sum(axis=2)

    def near(self, a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
        """Which rows of b lie within ``limit`` of which rows of a (boolean matrix)."""
        out = np.zeros((len(a), len(b)), bool)
        step = max(1, (1 << 17) // max(1, len(b) * a.shape[1]))
        for s in range(0, len(a), step):
            part = a[s : s + step]
            w = self.bound(part, b)
            sure = w < limit * (1 - 1e-9)
            i, j = np.nonzero((w * np.sqrt(0.5) < limit * (1 + 1e-9)) & ~sure)
            out[s : s + step] = sure
            out[s + i, j] = self.length(part[i] - b[j]) < limit
        return out

    def widest(self, a: np.ndarray, b: np.ndarray, known: float) -> float:
        """Largest length between rows of a and b, or ``known`` if that is larger."""
        step = max(1, (1 << 21) // max(1, len(b) * a.shape[1]))
        for s in range(0, len(a), step):
            part = a[s : s + step]
            i, j = np.nonzero(self.bound(part, b) > known)
            if len(i):
                known = max(known, float(self.length(part[i] - b[j]).max()))
        return known


def _matrix(col: pa.Array, n_features: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)


def _clean(rows: DataFrame, n_features: int, missing: float) -> DataFrame:
    """(row_id, y, x) with every missing value as ``missing``, as the cleaned tables have it."""
    x = F.coalesce(F.col("x"), F.array_repeat(F.lit(None).cast("double"), n_features))
    return rows.where("y IS NOT NULL").select("row_id", F.col("y").cast("int").alias("y"), F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v), F.lit(float(missing))).otherwise(v.cast("double"))).alias("x"))


NONE = np.zeros(0, np.int64)


def _read(batch: pa.RecordBatch, n_features: int, skip: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, ids, x) of the chunks of a batch, without the rows of the sorted ``skip``."""
    for _, y, ids, x in chunks.read(batch, n_features):
        if len(ids) and len(skip):
            at = np.flatnonzero(chunks.within(skip, ids))
            if len(at):
                keep = ~chunks.within(ids, skip)
                ids, x = ids[keep], x[keep]
        if len(ids):
            yield y, ids, x


def _lengths(rows: DataFrame, norm: PairNorm, n_features: int, centres: dict[int, np.ndarray], skip: np.ndarray, least: dict[int, float] | None = None) -> DataFrame:
    """(row_id, y, x, r) with ``r``, the norm of the difference from the class's centre: of each chunk the
    row with the largest, or with ``least`` all rows whose ``r`` is not under that of their class."""
    told = rows.sparkSession.sparkContext.broadcast((norm, centres, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm, centres, least = told.value
        for batch in batches:
            for y, ids, x in _read(batch, n_features, skip):
                r = norm.length(x - centres[y])
                at = np.array([r.argmax()]) if least is None else np.flatnonzero(r >= least[y])
                if len(at):
                    one = chunks.rows(y, ids[at], x[at])
                    yield pa.RecordBatch.from_arrays([*one.columns, pa.array(r[at])], names=["row_id", "y", "x", "r"])

    return rows.select("y", "ids", "x").mapInArrow(run, "row_id long, y int, x array<double>, r double")


def diameters(rows: DataFrame, n_features: int, pairs: Sequence[tuple[int, int]] | None = None, skip: np.ndarray = NONE) -> dict[int, float]:
    """Largest undivided divergence of two rows of each class: one number a class.  ``rows`` are
    (row_id, y, x) or chunks of them, of which the rows with the sorted ids ``skip`` take no part."""
    if not chunks.packed(rows):
        kept = chunks.pack(rows, n_features).persist(StorageLevel.DISK_ONLY)
        try:
            return diameters(kept, n_features, pairs, skip)
        finally:
            kept.unpersist()
    norm = PairNorm(n_features, pairs)
    # any centre will do: that of all rows of the chunks
    means = {r["y"]: np.array(r["m"], float) for r in rows.where("n > 0").groupBy("y").agg(F.array(*[F.sum(F.col("total")[i]) / F.sum("n") for i in range(n_features)]).alias("m")).collect()}
    ends = {r["y"]: (float(r["r"]), np.array([np.nan if v is None else v for v in r["x"]], float)) for r in _lengths(rows, norm, n_features, means, skip).groupBy("y").agg(F.max("r").alias("r"), F.max_by("x", F.struct("r", -F.col("row_id"))).alias("x")).collect()}
    if not ends:
        return {}
    from_end = _lengths(rows, norm, n_features, {y: x for y, (_, x) in ends.items()}, skip)
    known = {r["y"]: float(r["r"]) for r in from_end.groupBy("y").agg(F.max("r").alias("r")).collect()}
    least = {y: (known[y] - r) * (1 - 1e-12) for y, (r, _) in ends.items()}
    placed = _lengths(rows, norm, n_features, means, skip, least)
    far = cut_lineage(placed.groupBy("y", "x").agg(F.min("row_id").alias("row_id")).select("row_id", "y", "x"))
    told = rows.sparkSession.sparkContext.broadcast((norm, known))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), n_features)
            for c in np.unique(y):
                at = np.flatnonzero(y == c)
                for s in range(0, len(at), FAR_BLOCK):
                    own = at[s : s + FAR_BLOCK]
                    yield pa.RecordBatch.from_pylist([{"y": int(c), "first": int(ids[own].min()), "lo": x[own].min(axis=0), "hi": x[own].max(axis=0), "x": np.ascontiguousarray(x[own]).tobytes()}],
                                                     pa.schema([("y", pa.int32()), ("first", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("x", pa.binary())]))

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm, known = told.value
        best = dict(known)
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[c]).reshape(-1, n_features) for c in ("a", "b"))
                best[row["y"]] = norm.widest(a, b, best[row["y"]])
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], names=["y", "d"])

    # blocks are narrow in the feature that parts the class most; two meet only if their boxes allow a larger length
    per_class = lambda values: F.create_map(*[F.lit(v) for y, value in values.items() for v in (y, value)])[F.col("y")]
    main = {y: int(np.nan_to_num(np.abs(x - means[y]) * norm.weight).argmax()) for y, (_, x) in ends.items()}
    far = far.withColumn("o", F.get("x", per_class(main))).repartitionByRange("y", "o").sortWithinPartitions("y", "o").drop("o")
    packs = cut_lineage(far.mapInArrow(pack, "y int, first long, lo array<double>, hi array<double>, x binary"))
    both = packs.toDF("y", "a_first", "a_lo", "a_hi", "a").join(packs.toDF("y", "b_first", "b_lo", "b_hi", "b"), "y").where("a_first <= b_first")
    apart = F.zip_with(F.zip_with("a_hi", "b_lo", lambda u, v: u - v), F.zip_with("b_hi", "a_lo", lambda u, v: u - v), lambda u, v: F.greatest(u, v))
    most = F.aggregate(F.zip_with(apart, F.lit(norm.weight.tolist()), lambda d, w: d * w), F.lit(0.0), lambda s, v: s + v)
    both = both.where(most >= per_class({y: float(d) for y, d in known.items()}) * (1 - 1e-9)).select("y", "a", "b")
    found = both.mapInArrow(widest, "y int, d double").groupBy("y").agg(F.max("d").alias("d"))
    return known | {r["y"]: float(r["d"]) for r in found.collect()}


def limits(rows: DataFrame, n_features: int, min_divergence: float = MIN_DIVERGENCE, pairs: Sequence[tuple[int, int]] | None = None, skip: np.ndarray = NONE) -> dict[int, float]:
    """Undivided divergence below which two rows of a class are near; infinite where all are equal."""
    n_pairs = n_features * (n_features - 1) // 2 if pairs is None else len(pairs)
    return {y: min_divergence * (d + MAX_EPS * n_pairs) if d > 0 else float("inf") for y, d in diameters(rows, n_features, pairs, skip).items()}


def _walk(ids: np.ndarray, x: np.ndarray, norm: PairNorm, limit: float) -> np.ndarray:
    """Positions of the greedy leaders of rows in id order."""
    open_, out = np.ones(len(ids), bool), []
    while True:
        at = int(open_.argmax())
        if not open_[at]:
            return np.array(out, np.int64)
        out.append(at)
        rest = np.flatnonzero(open_)
        open_[rest[norm.near(x[rest], x[at : at + 1], limit)[:, 0]]] = False
        open_[at] = False


def leaders(rows: DataFrame, n_features: int, min_divergence: float = MIN_DIVERGENCE, pairs: Sequence[tuple[int, int]] | None = None,
            prefix: int | None = None, missing: float = MISSING_SENTINEL) -> DataFrame:
    """(row_id, y, leader) of ``rows`` (row_id, y, x): every greedy leader with the row selected for it,
    the smallest id within the limit of it (which can be an earlier row that another leader closed).

    Missing values stand as ``missing``; rows without a class take no part; equal ids are one row."""
    clean = chunks.pack(_clean(rows, n_features, missing).dropDuplicates(["row_id", "y"]), n_features).persist(StorageLevel.DISK_ONLY)
    try:
        return leaders_of_chunks(clean, n_features, min_divergence, pairs, prefix)
    finally:
        clean.unpersist()


def _first_open(open_: DataFrame, n_features: int, prefix: int, skip: np.ndarray) -> DataFrame:
    """(row_id, y, x) of the ``prefix`` smallest ids of each class of chunks."""
    # at least prefix rows are in the chunks that end first, so those of other chunks are not after them
    upto = F.sum("n").over(Window.partitionBy("y").orderBy("last"))
    ends = open_.where("n > 0").select("y", "n", "last").withColumn("upto", upto).groupBy("y")
    enough = prefix + len(skip)
    last = {r["y"]: r["t"] for r in ends.agg(F.coalesce(F.min(F.when(F.col("upto") >= enough, F.col("last"))), F.max("last")).alias("t")).collect()}
    told = open_.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for y, ids, x in _read(batch, n_features, skip):
                n = min(prefix, int(np.searchsorted(ids, told.value[y], "right")))
                if n and y in held:
                    both, values = np.concatenate([held[y][0], ids[:n]]), np.concatenate([held[y][1], x[:n]])
                    order = np.argsort(both, kind="stable")[:prefix]
                    held[y] = both[order], values[order]
                elif n:
                    held[y] = ids[:n].copy(), x[:n].copy()
        for y, (ids, x) in held.items():
            yield chunks.rows(y, ids, x)

    if not last:
        return open_.sparkSession.createDataFrame([], "row_id long, y int, x array<double>")
    begun = F.create_map(*[F.lit(v) for y, t in last.items() for v in (y, t)])[F.col("y")]
    found = open_.where(F.col("first") <= begun).select("y", "ids", "x").mapInArrow(run, "row_id long, y int, x array<double>")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("row_id"))).where(F.col("n") <= prefix).drop("n")


def leaders_of_chunks(clean: DataFrame, n_features: int, min_divergence: float = MIN_DIVERGENCE, pairs: Sequence[tuple[int, int]] | None = None,
                      prefix: int | None = None, skip: np.ndarray = NONE) -> DataFrame:
    """``leaders`` of rows that the caller keeps as chunks, each id once and without missing values; the
    rows with the sorted ids ``skip`` take no part."""
    spark = clean.sparkSession
    limit = limits(clean, n_features, min_divergence, pairs, skip)
    empty = spark.createDataFrame([], "row_id long, y int, leader long")
    if not limit:
        return empty
    norm = PairNorm(n_features, pairs)
    prefix = prefix or max(64, min(4096, ROUND_BYTES // (8 * n_features * len(limit))))
    rule = spark.sparkContext.broadcast((norm, limit))

    def walk(t: pa.Table) -> pa.Table:
        norm, limit = rule.value
        t = t.sort_by("row_id")
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
        return t.take(pa.array(_walk(t.column("row_id").to_numpy(), x, norm, limit[t.column("y")[0].as_py()])))

    open_, found = clean, []
    while True:
        new = cut_lineage(_first_open(open_, n_features, prefix, skip).groupBy("y").applyInArrow(walk, "row_id long, y int, x array<double>"))
        # at most prefix rows a class: ROUND_BYTES, or 64 rows a class
        got: dict[int, tuple[list, list]] = {}
        for r in new.collect():
            ids, xs = got.setdefault(r["y"], ([], []))
            ids.append(r["row_id"]), xs.append(r["x"])
        if not got:
            break
        told = spark.sparkContext.broadcast({c: (np.array(i), np.array(x, float)) for c, (i, x) in got.items()})
        # a row selected for a leader is never after it
        last = max(max(i) for i, _ in got.values())

        def select(batches: Iterator[pa.RecordBatch], told=told, last=last) -> Iterator[pa.RecordBatch]:
            norm, limit = rule.value
            best: dict[int, np.ndarray] = {c: np.full(len(i), np.iinfo(np.int64).max) for c, (i, _) in told.value.items()}
            for b in batches:
                for c, ids, x in _read(b, n_features, skip):
                    n = int(np.searchsorted(ids, last, "right"))
                    if c in best and n:
                        near = norm.near(x[:n], told.value[c][1], limit[c])
                        best[c] = np.minimum(best[c], np.where(near.any(axis=0), ids[near.argmax(axis=0)], np.iinfo(np.int64).max))
            for c, least in best.items():
                seen = least < np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays([pa.array(least[seen]), pa.array(np.full(seen.sum(), c, np.int32)), pa.array(told.value[c][0][seen])], names=["row_id", "y", "leader"])

        def close(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            norm, limit = rule.value
            for b in batches:
                for c, ids, x in _read(b, n_features, skip):
                    stay = np.arange(len(ids))
                    if c in told.value:
                        # a row that a leader closed does not meet the others
                        for a in range(0, len(told.value[c][1]), CLOSERS):
                            stay = stay[~norm.near(x[stay], told.value[c][1][a : a + CLOSERS], limit[c]).any(axis=1)]
                    if len(stay):
                        yield chunks.chunk(c, ids[stay], x[stay])

        chosen = clean.where(F.col("first") <= last).select("y", "ids", "x").mapInArrow(select, "row_id long, y int, leader long")
        found.append(cut_lineage(chosen.groupBy("y", "leader").agg(F.min("row_id").alias("row_id")).select("row_id", "y", "leader")))
        open_ = cut_lineage(open_.select("y", "ids", "x").mapInArrow(close, f"{chunks.ABOUT_SQL}, ids binary, x binary"))
    out = empty
    for part in found:
        out = out.unionByName(part)
    return out
