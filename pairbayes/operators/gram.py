"""Blocked Gram sums: moments of all feature pairs, correlations and principal components.

A task multiplies its rows' feature blocks (X'X) and returns one row for each class and
feature pair, whatever its number of rows; Spark adds those up.  Sums are taken of values
less a common shift (the overall mean), so nothing is lost to cancellation.  Missing
values (null or NaN) are left out pair by pair."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of sums that a task keeps; wider tables return theirs every 4 F rows.
SUM_BYTES = 64 << 20
STRIP = 512
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _matrix(col: pa.Array, n_features: int) -> np.ndarray:
    """Rows as doubles; null arrays and null values are NaN."""
    out = np.full((len(col), n_features), np.nan)
    out[col.is_valid().to_numpy(zero_copy_only=False)] = col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
    return out


def feature_means(fx: DataFrame, n_features: int) -> np.ndarray:
    """Mean of every feature over all rows (0 where there is none): scalars of the schema."""
    each = ", ".join(f"avg(CASE WHEN NOT isnan(x[{i}]) THEN x[{i}] END)" for i in range(n_features))
    row = fx.agg(F.expr(f"array({each})").alias("m")).first()
    return np.array([0.0 if v is None else v for v in row["m"]])


def gram_sums(fx_y: DataFrame, n_features: int, shift: np.ndarray) -> DataFrame:
    """(y, i, j, n, sx, sy, sxx, syy, sxy), i <= j, over the rows that have both features, of values
    less ``shift``; and a row (y, -1, -1, rows) for each class."""
    told = fx_y.sparkSession.sparkContext.broadcast(np.asarray(shift, float))
    strips = [np.arange(a, min(a + STRIP, n_features)) for a in range(0, n_features, STRIP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list[np.ndarray]] = {}
        rows: dict[int, int] = {}
        held, size = [], 0

        def add() -> None:
            y = np.concatenate([h[0] for h in held])
            x = np.concatenate([h[1] for h in held]) - told.value
            held.clear()
            for c in np.unique(y).tolist():
                own = x[y == c]
                rows[c] = rows.get(c, 0) + len(own)
                there = ~np.isnan(own)
                zero = np.where(there, own, 0.0)
                there = there.astype(float)
                for a, left in enumerate(strips):
                    for b in range(a, len(strips)):
                        right = strips[b]
                        xl, xr, ml, mr = zero[:, left], zero[:, right], there[:, left], there[:, right]
                        parts = [ml.T @ mr, xl.T @ mr, ml.T @ xr, (xl * xl).T @ mr, ml.T @ (xr * xr), xl.T @ xr]
                        known = total.setdefault((c, a, b), [np.zeros_like(parts[0]) for _ in parts])
                        for k, part in zip(known, parts):
                            k += part

        def out() -> Iterator[pa.RecordBatch]:
            for (c, a, b), parts in total.items():
                i, j = (g.ravel() for g in np.meshgrid(strips[a], strips[b], indexing="ij"))
                use = np.flatnonzero((i <= j) & (parts[0].ravel() > 0))
                cols = [pa.array(np.full(len(use), c, np.int32)), pa.array(i[use].astype(np.int32)), pa.array(j[use].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(p.ravel()[use]) for p in parts]], names=["y", "i", "j", *SUMS])
            total.clear()

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32), _matrix(batch.column(1), n_features)))
            size += batch.num_rows
            if size >= max(4096, 4 * n_features):
                add()
                size = 0
                if len(rows) * n_features * n_features * 8 * len(SUMS) > SUM_BYTES:
                    yield from out()
        if held:
            add()
        yield from out()
        none = pa.array(np.zeros(len(rows)))
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *[pa.array(np.full(len(rows), -1, np.int32))] * 2, pa.array(list(rows.values()), pa.float64()), *[none] * 5], names=["y", "i", "j", *SUMS])

    source = fx_y.where("y IS NOT NULL").select(F.col("y").cast("int").alias("y"), F.col("x").cast("array<double>").alias("x"))
    sums = source.mapInArrow(run, "y int, i int, j int, " + ", ".join(f"{c} double" for c in SUMS))
    return sums.groupBy("y", "i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def pair_covariances(fx_y: DataFrame, n_features: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows per class, single features, pairs) from one pass:

    (y, rows); (y, i, n, mean, s2) with s2 the sum of squared differences from the mean;
    (y, i, j, n, c, ci, cj): the sums of products and squares about the means of the rows that have both."""
    shift = feature_means(fx_y, n_features)
    g = gram_sums(fx_y, n_features, shift)
    moved = F.array(*[F.lit(float(v)) for v in shift]) if n_features <= 256 else F.lit([float(v) for v in shift])
    about = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    single = g.where("i >= 0 AND i = j").select("y", "i", "n", (F.col("sx") / F.col("n") + moved[F.col("i")]).alias("mean"), F.greatest(about("sx", "sx", "sxx"), F.lit(0.0)).alias("s2"))
    pairs = g.where("i < j").select("y", "i", "j", "n", about("sx", "sy", "sxy").alias("c"), F.greatest(about("sx", "sx", "sxx"), F.lit(0.0)).alias("ci"), F.greatest(about("sy", "sy", "syy"), F.lit(0.0)).alias("cj"))
    return g.where("i < 0").select("y", F.col("n").cast("long").alias("rows")), single, pairs


def pair_number(n_features: int) -> F.Column:
    """Place of (i, j) in the sorted order of all pairs."""
    i, j = F.col("i"), F.col("j")
    return (i * n_features - F.floor(i * (i + 1) / 2) + j - i - 1).cast("int")


def wanted_pairs(df: DataFrame, pairs: Sequence[tuple[int, int]] | None, n_features: int) -> DataFrame:
    """``df`` with ``pair_id``: all pairs, or the given ones (as a small table) in their own order."""
    if pairs is None:
        return df.withColumn("pair_id", pair_number(n_features))
    told = df.sparkSession.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(pairs)], "pair_id int, i int, j int")
    return df.join(told, ["i", "j"])


def correlations(fx: DataFrame, n_features: int) -> DataFrame:
    """(i, j, corr) of all feature pairs i < j over the rows that have both; null where one is constant."""
    _, _, pairs = pair_covariances(fx.select(F.lit(0).alias("y"), "x"), n_features)
    return pairs.select("i", "j", F.try_divide(F.col("c"), F.sqrt(F.col("ci")) * F.sqrt(F.col("cj"))).alias("corr"))


@dataclass
class Components:
    """Principal components of standardised features (population standard deviation)."""

    mean: np.ndarray
    std: np.ndarray
    loadings: np.ndarray  # one row a component; its largest loading is positive
    variance: np.ndarray  # share of the whole variance

    def frame(self, spark) -> DataFrame:
        rows = [(c, f, float(v)) for c, row in enumerate(self.loadings) for f, v in enumerate(row)]
        return spark.createDataFrame(rows, "component int, feature int, loading double")


def principal_components(fx: DataFrame, n_features: int, k: int = 2) -> Components:
    """Eigenvectors of the correlation matrix; only that matrix (F x F) reaches the driver.

    A constant feature stands as 0.  Of a component and its negative the one is taken whose largest
    loading by size (the first, if equal) is positive."""
    _, single, pairs = pair_covariances(fx.select(F.lit(0).alias("y"), "x"), n_features)
    mean, std, c = np.zeros(n_features), np.zeros(n_features), np.zeros((n_features, n_features))
    for r in single.collect():
        mean[r["i"]], std[r["i"]] = r["mean"], np.sqrt(r["s2"] / r["n"])
    scale = np.where(std > 0, std, 1.0)
    for r in pairs.collect():
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["c"] / r["n"] / scale[r["i"]] / scale[r["j"]]
    c[np.diag_indices(n_features)] = std > 0
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values, kind="stable")[:k]
    loadings = vectors[:, order].T
    top = np.abs(loadings).argmax(axis=1)
    loadings = loadings * np.where(loadings[np.arange(len(order)), top] < 0, -1.0, 1.0)[:, None]
    return Components(mean, std, loadings, values[order] / max(values.sum(), 1e-300))


def component_scores(fx: DataFrame, model: Components) -> DataFrame:
    """(row_id, pc array<double>); a missing value counts as the feature's mean."""
    told = fx.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        for batch in batches:
            z = (_matrix(batch.column(1), len(m.mean)) - m.mean) / np.where(m.std > 0, m.std, 1.0)
            pc = np.where(np.isnan(z) | (m.std == 0), 0.0, z) @ m.loadings.T
            offsets = pa.array(np.arange(0, pc.size + 1, len(m.loadings), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(pc.ravel()))], names=["row_id", "pc"])

    rows = fx.select("row_id", F.col("x").cast("array<double>").alias("x"))
    return rows.mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, pc array<double>")
