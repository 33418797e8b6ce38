"""Features from class probabilities (B20) and what the reconstruction loses.

The learned inverse is a ridge least-squares map from (1, posterior) to the features.  Its
normal equations are sums over the rows, so a pass returns (C + 1) x (C + 1 + F) numbers a
task and the driver solves a system of C + 1 unknowns.  The losses are aggregates: squared
error and correlation row by row, a normal divergence feature by feature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.operators.gram import _matrix

# Fixed values of the reconstruction loss.
CORR_SHARE, KL_SHARE, LOSS_EPS = 0.1, 0.01, 1e-8
RIDGE = 1.0


def fit_inverse(scored: DataFrame, n_classes: int, n_features: int, ridge: float = RIDGE, post: str = "posterior", x: str = "x") -> np.ndarray:
    """Weights (C + 1) x F of the map; the first row belongs to the constant, which is not held down.

    Rows with a missing feature or probability do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_classes + 1, n_classes + 1 + n_features))
        for batch in batches:
            both = np.c_[np.ones(batch.num_rows), _matrix(batch.column(0), n_classes), _matrix(batch.column(1), n_features)]
            both = both[~np.isnan(both).any(axis=1)]
            total += both[:, : n_classes + 1].T @ both
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    rows = scored.select(F.col(post).cast("array<double>").alias("p"), F.col(x).cast("array<double>").alias("x"))
    sums = np.zeros((n_classes + 1, n_classes + 1 + n_features))
    for r in rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r["i"], r["j"]] = r["s"]
    a = sums[:, : n_classes + 1] + np.diag([0.0] + [ridge] * n_classes)
    return np.linalg.lstsq(a, sums[:, n_classes + 1 :], rcond=None)[0]


def invert(scored: DataFrame, weights: np.ndarray, post: str = "posterior") -> DataFrame:
    """``scored`` with ``x_hat``, the features that its posterior stands for; null without a posterior."""
    told = F.lit([[float(v) for v in row] for row in weights.T])  # F x (C + 1) numbers of the schema
    c = F.sequence(F.lit(1), F.lit(len(weights) - 1))
    hat = F.transform(told, lambda w: F.aggregate(c, w[0], lambda s, k: s + F.col(post)[k - 1] * w[k]))
    return scored.withColumn("x_hat", F.when(F.col(post).isNotNull(), hat))


def feature_errors(rec: DataFrame) -> DataFrame:
    """(feature, n, mse) over all rows, and feature -1 with the mean and standard deviation of the rows' errors."""
    pair = rec.select(F.posexplode(F.arrays_zip(F.col("x").alias("a"), F.col("x_hat").alias("b"))).alias("feature", "v"))
    d = F.col("v.a") - F.col("v.b")
    each = pair.groupBy("feature").agg(F.count(d).alias("n"), F.avg(d * d).alias("mse"), F.lit(None).cast("double").alias("std"))
    whole = row_errors(rec).agg(F.lit(-1).alias("feature"), F.count("mse").alias("n"), F.avg("mse").alias("mse"), F.stddev_samp("mse").alias("std"))
    return each.unionByName(whole)


def row_errors(rec: DataFrame) -> DataFrame:
    """``rec`` with ``mse``, the mean squared error of each row; null for an empty or missing vector."""
    squares = F.aggregate(F.zip_with("x", "x_hat", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return rec.withColumn("mse", F.try_divide(squares, F.size("x")))


def losses(rec: DataFrame) -> DataFrame:
    """B20's loss terms of (x, x_hat) as one row: mse, corr, kl, total.

    Features are scaled by the originals' range (1, if they are constant).  corr is minus the mean
    cosine of the rows about the column means; kl the mean divergence of the two normal laws of a
    feature; total = mse + 0.1 * corr + 0.01 * kl."""
    pair = rec.where("x IS NOT NULL AND x_hat IS NOT NULL").select("x", "x_hat")
    long = pair.select(F.posexplode(F.arrays_zip(F.col("x").alias("a"), F.col("x_hat").alias("b"))).alias("f", "v")).select("f", "v.a", "v.b")
    stats = long.groupBy("f").agg(*[g(c).alias(f"{c}{n}") for c in "ab" for n, g in (("m", F.avg), ("s", F.stddev_samp))], F.min("a").alias("lo"), F.max("a").alias("hi"))
    rows = sorted(stats.collect(), key=lambda r: r["f"])  # numbers of the schema
    if not rows:
        return pair.sparkSession.createDataFrame([], "mse double, corr double, kl double, total double")
    lo = [float(r["lo"]) for r in rows]
    width = [float(r["hi"] - r["lo"]) or 1.0 for r in rows]
    ma, mb = [(r["am"] - a) / w for r, a, w in zip(rows, lo, width)], [(r["bm"] - a) / w for r, a, w in zip(rows, lo, width)]
    sa, sb = [np.array([(r[c] or 0.0) / w for r, w in zip(rows, width)]) + LOSS_EPS for c in ("as", "bs")]
    kl = float(np.mean(np.log(sb / sa) + (sa**2 + (np.array(ma) - np.array(mb)) ** 2) / (2 * sb**2) - 0.5))
    scaled = lambda c: F.transform(c, lambda v, i: (v - F.lit(lo)[i]) / F.lit(width)[i])
    centred = lambda c, m: F.transform(c, lambda v, i: v - F.lit(m)[i])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    s = pair.select(scaled("x").alias("a"), scaled("x_hat").alias("b"))
    s = s.select("a", "b", centred("a", ma).alias("ca"), centred("b", mb).alias("cb"))
    corr = -dot("ca", "cb") / (F.sqrt(dot("ca", "ca")) * F.sqrt(dot("cb", "cb")) + F.lit(LOSS_EPS))
    diff = F.zip_with("a", "b", lambda u, v: (u - v) * (u - v))
    mse = F.aggregate(diff, F.lit(0.0), lambda t, v: t + v) / F.size("a")
    out = s.select(mse.alias("mse"), corr.alias("corr")).agg(F.avg("mse").alias("mse"), F.avg("corr").alias("corr")).withColumn("kl", F.lit(kl))
    return out.withColumn("total", F.col("mse") + CORR_SHARE * F.col("corr") + KL_SHARE * F.col("kl"))
