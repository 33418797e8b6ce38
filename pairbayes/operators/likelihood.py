"""Pairwise 2-D histograms per class (A4, A5, B4) and class moments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.operators.binning import BinSpec, double_sql
from pairbayes.operators.dense import dense_counts
from pairbayes.operators.gram import pair_covariances, wanted_pairs

# Fixed values of the classifier.
INITIAL_WEIGHT = 1e-6
EPSILON = 1e-10
SMOOTH_EPS = 1e-8
# The scoring join broadcasts the model table in blocks of pairs of at most this
# many bytes each; the size is *checked* (row count x row width).
BROADCAST_BYTES = 64 * 1024 * 1024

CELL_KEYS = ["pair_id", "bi", "bj"]


@dataclass
class HistogramModel:
    """Sparse pairwise-histogram model.

    counts : (y, pair_id, bi, bj, n)  -- occupied cells only
    weights: (y, pair_id, bi, bj, w)  -- updated cells only; others are w0
    """

    spec: BinSpec
    pairs: tuple[tuple[int, int], ...] | None  # None = all pairs of n_features
    n_features: int
    classes: tuple[str, ...]
    class_counts: tuple[int, ...]
    counts: DataFrame
    weights: DataFrame | None = None
    w0: float = INITIAL_WEIGHT
    eps: float = EPSILON
    lr: float = 0.1
    overlap_mask: bool = False
    cells: DataFrame | None = None  # (pair_id, bi, bj, ns): the counts with all classes of a cell in one row
    _table: DataFrame | None = field(default=None, repr=False)
    _table_rows: int | None = field(default=None, repr=False)

    @property
    def n_pairs(self) -> int:
        if self.pairs is None:
            return self.n_features * (self.n_features - 1) // 2
        return len(self.pairs)

    @property
    def n_classes(self) -> int:
        return len(self.classes)

    @property
    def B(self) -> int:
        return self.spec.n_bins

    def p0(self) -> list[float]:
        """Probability of an empty cell per class: 1/(n_c + B^2 + 1e-8)."""
        return [1.0 / (n + self.B * self.B + SMOOTH_EPS) for n in self.class_counts]

    def with_weights(self, weights: DataFrame | None) -> "HistogramModel":
        return replace(self, weights=weights, _table=None, _table_rows=None)


def fit_counts(fx_y: DataFrame, spec: BinSpec, pairs, n_features: int, n_classes: int, n_rows: int = 0) -> DataFrame:
    """A4: counts ``(y, pair_id, bi, bj, n)`` of the occupied cells, from dense blocks."""
    return _by_class(*dense_counts(fx_y, spec, pairs, n_features, n_classes, n_rows))


def _by_class(cells: DataFrame, whole: bool) -> DataFrame:
    each = cells.select(*CELL_KEYS, F.posexplode("ns").alias("y", "n")).where("n > 0").select("y", *CELL_KEYS, "n")
    return each if whole else each.groupBy("y", *CELL_KEYS).agg(F.sum("n").alias("n"))


def fit_histogram(fx_y: DataFrame, spec: BinSpec, classes: Sequence[str], pairs=None,
                  n_features: int | None = None, w0: float = INITIAL_WEIGHT, eps: float = EPSILON,
                  persist: bool = True, class_counts: Sequence[int] | None = None) -> HistogramModel:
    """B4 inputs: cell counts and class totals.  ``fx_y`` has ``y`` codes and ``x``."""
    nf = n_features or spec.n_features
    if class_counts is None:
        totals = {r["y"]: r["n"] for r in fx_y.groupBy("y").count().withColumnRenamed("count", "n").collect()}
        class_counts = [int(totals.get(c, 0)) for c in range(len(classes))]
    class_counts = tuple(int(n) for n in class_counts)
    cells, whole = dense_counts(fx_y, spec, pairs, nf, len(classes), sum(class_counts))
    if persist and whole:
        cells = cells.persist()
    counts = _by_class(cells, whole)
    if persist and not whole:
        counts = counts.persist()
    return HistogramModel(spec, None if pairs is None else tuple(pairs), nf, tuple(classes), class_counts,
                          counts, None, w0, eps, cells=cells if whole else None)


def probabilities(model: HistogramModel) -> DataFrame:
    """``(y, pair_id, bi, bj, n, p)`` for occupied cells with
    p = (n+1)/(n_c + B^2 + 1e-8)."""
    nc = F.lit([float(n) for n in model.class_counts])
    B2 = float(model.B * model.B)
    return model.counts.withColumn("p", (F.col("n") + F.lit(1.0)) / (nc[F.col("y")] + F.lit(B2) + F.lit(SMOOTH_EPS)))


def model_table(model: HistogramModel) -> DataFrame:
    """Per cell ``(pair_id, bi, bj, p array[C], d array[C])`` where
    d[c] = ln(p_c w_c + eps) - ln(p0_c w0 + eps)  (0 for absent entries).

    Rows exist only for cells some class occupies or some weight update
    touched, so the table is bounded by min(N*P, P*B^2)."""
    if model._table is not None:
        return model._table
    C = model.n_classes
    p0 = F.lit(model.p0())
    if _from_cells(model):
        model._table = _table_of_cells(model)
        return model._table
    e = probabilities(model).select("y", *CELL_KEYS, "p")
    if model.weights is not None:
        e = e.join(model.weights.select("y", *CELL_KEYS, "w"), ["y", *CELL_KEYS], "full_outer")
        w = F.coalesce(F.col("w"), F.lit(model.w0))
    else:
        w = F.lit(model.w0)
    p = F.coalesce(F.col("p"), p0[F.col("y")])
    base = F.ln(p0[F.col("y")] * F.lit(model.w0) + F.lit(model.eps))
    e = e.select("y", *CELL_KEYS, p.alias("p"), (F.ln(p * w + F.lit(model.eps)) - base).alias("d"))
    aggs = []
    for c in range(C):
        aggs.append(F.max(F.when(F.col("y") == c, F.col("p"))).alias(f"p{c}"))
        aggs.append(F.sum(F.when(F.col("y") == c, F.col("d"))).alias(f"d{c}"))
    t = e.groupBy(*CELL_KEYS).agg(*aggs)
    t = t.select(
        *CELL_KEYS,
        F.array(*[F.coalesce(F.col(f"p{c}"), p0[c]) for c in range(C)]).alias("p"),
        F.array(*[F.coalesce(F.col(f"d{c}"), F.lit(0.0)) for c in range(C)]).alias("d"),
    )
    if model.overlap_mask:
        # Cells occupied by >= 2 classes carry p = 0 for every class,
        # i.e. ln(eps) instead of ln(p*w + eps).
        import math

        ov = occupied_cells(model).select(*CELL_KEYS, F.lit(True).alias("__ov"))
        masked = F.array(*[F.lit(math.log(model.eps) - math.log(p0v * model.w0 + model.eps)) for p0v in model.p0()])
        t = t.join(ov, CELL_KEYS, "left").select(
            *CELL_KEYS, "p", F.when(F.col("__ov"), masked).otherwise(F.col("d")).alias("d"))
    model._table = t
    return t


def _from_cells(model: HistogramModel) -> bool:
    """True where the table is a projection of the kept cells, which needs no copy of its own."""
    return model.cells is not None and model.weights is None and not model.overlap_mask


def _table_of_cells(model: HistogramModel) -> DataFrame:
    """The same table where every cell is one row and no weight was updated: no shuffle."""
    lit, B2, p, d = double_sql, float(model.B * model.B), [], []
    for c, (total, p0) in enumerate(zip(model.class_counts, model.p0())):
        own = f"(ns[{c}] + 1D) / {lit(float(total) + B2 + SMOOTH_EPS)}"
        base = f"ln({lit(p0)} * {lit(model.w0)} + {lit(model.eps)})"
        p.append(f"CASE WHEN ns[{c}] > 0 THEN {own} ELSE {lit(p0)} END")
        d.append(f"CASE WHEN ns[{c}] > 0 THEN ln({own} * {lit(model.w0)} + {lit(model.eps)}) - {base} ELSE 0D END")
    return model.cells.select(*CELL_KEYS, F.expr(f"array({', '.join(p)})").alias("p"), F.expr(f"array({', '.join(d)})").alias("d"))


def materialize_table(model: HistogramModel) -> tuple[DataFrame, int]:
    """Persist the model table and count its rows (the count is the size
    check for broadcasting).  Its lineage is short: persisted counts plus the
    weight table, which the training loop checkpoints every epoch."""
    from pyspark import StorageLevel

    if model._table_rows is None:
        t = model_table(model)
        if t.storageLevel == StorageLevel.NONE and not _from_cells(model):
            t = t.persist(StorageLevel.MEMORY_AND_DISK)
        model._table = t
        model._table_rows = t.count()
    return model._table, model._table_rows


def pair_blocks(model: HistogramModel, limit: int = BROADCAST_BYTES, arrays: int = 1) -> list[tuple[int, int]]:
    """Ranges ``[a, b)`` of pair ids whose model rows (3 int keys, ``arrays``
    arrays of C doubles, row overhead) fit ``limit`` bytes: one range while the
    model is small, more as it grows.  Ranges are halved until the largest fits
    (one number a range comes to the driver); a single pair holds at most B^2 cells."""
    table, rows = materialize_table(model)
    row_bytes = 12 + arrays * (8 * model.n_classes + 16) + 32
    n, blocks = model.n_pairs, 1
    while blocks < n:
        width = -(-n // blocks)
        most = rows if blocks == 1 else table.groupBy(F.floor(F.col("pair_id") / width)).count().agg(F.max("count")).first()[0] or 0
        if most * row_bytes <= limit:
            break
        blocks *= 2
    width = max(1, -(-n // blocks))
    return [(a, min(a + width, n)) for a in range(0, n, width)]


def occupied_cells(model: HistogramModel) -> DataFrame:
    """A5: cells occupied by >= 2 classes, with how many."""
    return (
        model.counts.groupBy(*CELL_KEYS)
        .agg(F.countDistinct("y").alias("n_classes"))
        .where(F.col("n_classes") >= 2)
    )


def class_moments(fx_y: DataFrame, pairs, n_features: int) -> DataFrame:
    """Per (class, pair) mean and covariance with the reference's
    regularisation: cov = S/(n-1+1e-6) + 1e-6 on the diagonal.

    One pass of blocked Gram sums (``operators/gram.py``); what is shuffled is
    one row per (task, class, pair)."""
    rows, single, both = pair_covariances(fx_y, n_features)
    both = wanted_pairs(both, pairs, n_features)
    one = lambda i, m, v: single.select("y", F.col("i").alias(i), F.col("mean").alias(m), F.when(F.col("n") > 1, F.col("s2") / (F.col("n") - 1)).alias(v))
    g = both.join(rows, "y").join(one("i", "m1", "v11"), ["y", "i"]).join(one("j", "m2", "v22"), ["y", "j"])
    scale = (F.col("rows") - F.lit(1.0)) / (F.col("rows") - F.lit(1.0) + F.lit(1e-6))
    v12 = F.when(F.col("n") > 1, F.col("c") / (F.col("n") - 1))
    return g.select(
        "y",
        "pair_id",
        F.col("rows").alias("n"),
        "m1",
        "m2",
        (F.coalesce(F.col("v11") * scale, F.lit(0.0)) + F.lit(1e-6)).alias("c11"),
        F.coalesce(v12 * scale, F.lit(0.0)).alias("c12"),
        (F.coalesce(F.col("v22") * scale, F.lit(0.0)) + F.lit(1e-6)).alias("c22"),
    )
