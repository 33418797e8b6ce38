"""Posterior scoring (B6 histogram, B7 Gaussian, W4 argmax).

Histogram score, exact and sparse:
  ll(row, c) = P*ln(p0_c*w0 + eps) + sum over the row's pair cells of d[c]
where d is the per-cell correction from ``model_table`` (0 for cells the
model does not hold).  Blocks of the model table are broadcast and looked up in the
task that reads the row; no row is made for a row and pair.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pairbayes.functions.columns import argmax_first, softmax  # noqa: F401

from pairbayes.operators.binning import bin_rows
from pairbayes.operators.chunks import packed
from pairbayes.operators.dense import unrank_pairs
from pairbayes.operators.likelihood import BROADCAST_BYTES, HistogramModel, materialize_table, pair_blocks
from pairbayes.operators.lookup import block_cells, class_sums
from pairbayes.session import cut_lineage


def log_likelihoods(model: HistogramModel, fx: DataFrame, keep=("row_id", "y"), limit: int = BROADCAST_BYTES,
                    with_bins: bool = False, unique: bool = False) -> DataFrame:
    """``(keep..., ll array<double>[C] [, b])`` for every row of ``fx``.

    The pairs are dealt into blocks whose part of the model fits ``limit`` and is
    broadcast; a task sums its rows' cells of a block (``operators/lookup.py``).  The one
    shuffle (on ``keep``) carries one row per input row and block, whatever the model's
    size; with one block it is left out where the caller knows ``keep`` to be ``unique``."""
    C = model.n_classes
    P = model.n_pairs
    binned = bin_rows(fx, model.spec, keep=keep)
    keep2 = tuple(keep) + (("b",) if with_bins else ())
    side = materialize_table(model)[0]
    blocks = pair_blocks(model, limit)
    parts = [class_sums(binned, block_cells(side, "d", block, model.pairs, model.n_features, model.B, [0.0] * C, limit), keep, model.n_features, C) for block in blocks]
    base = [P * math.log(p0 * model.w0 + model.eps) for p0 in model.p0()]
    if unique and len(parts) == 1:
        ll = F.array(*[F.col("s")[c] + F.lit(base[c]) for c in range(C)])
        return parts[0].select(*keep, ll.alias("ll"), *(["b"] if with_bins else []))
    j = reduce(DataFrame.unionByName, parts)
    # the bins are a function of the row, so grouping by them too keeps the
    # groups and the fixed-width hash aggregate (first() of an array would
    # force a sort-based aggregate)
    g = j.groupBy(*keep2).agg(*[F.sum(F.col("s")[c]).alias(f"s{c}") for c in range(C)])
    ll = F.array(*[F.coalesce(F.col(f"s{c}"), F.lit(0.0)) + F.lit(base[c]) for c in range(C)])
    return g.select(*keep, ll.alias("ll"), *(["b"] if with_bins else []))


def posterior_columns(df: DataFrame, eps: float, ll: str = "ll") -> DataFrame:
    """softmax + argmax in separate projections, so the max, the exp array
    and its sum are computed once per row (a nested expression would
    re-evaluate them inside every lambda call)."""
    df = df.withColumn("__m", F.array_max(ll))
    df = df.withColumn("__e", F.transform(ll, lambda v: F.exp(v - F.col("__m"))))
    df = df.withColumn("__s", F.aggregate("__e", F.lit(0.0).cast("double"), lambda a, v: a + v))
    df = df.withColumn("posterior", F.transform("__e", lambda v: v / (F.col("__s") + F.lit(eps))))
    df = df.withColumn("confidence", F.array_max("posterior"))
    df = df.withColumn("pred", (F.array_position("posterior", F.col("confidence")) - F.lit(1)).cast("int"))
    return df.drop("__m", "__e", "__s")


def score(model: HistogramModel, fx: DataFrame, keep=("row_id", "y"), limit: int = BROADCAST_BYTES,
          with_bins: bool = False, unique: bool = False) -> DataFrame:
    """B6 + W4: ``(keep..., ll, posterior array, confidence double, pred int)``;
    ties of the maximum go to the lowest class code.

    Rows that are kept as chunks (``operators/chunks.py``) stay chunks, with ``posterior`` as
    a matrix instead of the bins, and how many rows are ``right``."""
    if packed(fx):
        return _score_chunks(model, fx, limit)
    ll = log_likelihoods(model, fx, keep=keep, limit=limit, with_bins=with_bins, unique=unique)
    return posterior_columns(ll, model.eps)


def _score_chunks(model: HistogramModel, chunks: DataFrame, limit: int) -> DataFrame:
    """``chunks`` with ``posterior`` (row x class doubles) and ``right`` for ``b``: block after block of
    pairs is added to the sums in the task that holds the chunk, nothing is shuffled."""
    C, P, F_ = model.n_classes, model.n_pairs, model.n_features
    side = materialize_table(model)[0]
    blocks = pair_blocks(model, limit)
    base, eps = [P * math.log(p0 * model.w0 + model.eps) for p0 in model.p0()], model.eps
    kept = [c for c in chunks.columns if c != "b"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*kept).schema)

    def sums(told, first: bool, last: bool):
        def run(batches):
            cells, made = told.value, ["posterior", "right"] if last else ["b", "s"]
            for batch in batches:
                b, y = (batch.column(batch.schema.get_field_index(c)) for c in ("b", "y"))
                for k in range(batch.num_rows):
                    bins = np.frombuffer(b[k].as_buffer(), "<u2").reshape(F_, -1).astype(np.int64)
                    s = np.zeros((bins.shape[1], C)) if first else np.frombuffer(batch.column(len(kept) + 1)[k].as_buffer()).reshape(-1, C).copy()
                    for p in range(len(cells.i)):
                        s += cells.values.take(cells.rows_of(cells.codes_of(bins, p)), axis=0)
                    one = batch.slice(k, 1)
                    if last:
                        posterior, pred = posteriors(s + np.array(base), eps)
                        more = [pa.array([posterior.tobytes()], pa.binary()), pa.array([int((pred == y[k].as_py()).sum())], pa.int64())]
                    else:
                        more = [one.column(len(kept)), pa.array([s.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*one.columns[: len(kept)], *more], names=[*kept, *made])

        return run

    out = chunks.select(*kept, "b")
    for n, block in enumerate(blocks):
        first, last = n == 0, n == len(blocks) - 1
        told = block_cells(side, "d", block, model.pairs, F_, model.B, [0.0] * C, limit)
        out = out.mapInArrow(sums(told, first, last), f"{kinds}, " + ("posterior binary, right long" if last else "b binary, s binary"))
        if n % 4 == 3 and not last:
            out = cut_lineage(out)  # few workers a task
    return out


def posteriors(ll: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """``posterior_columns`` for a matrix: (posterior, class of its first maximum)."""
    with np.errstate(invalid="ignore"):
        e = np.exp(ll - ll.max(axis=1, keepdims=True))
    s = np.zeros(len(e))
    for c in range(e.shape[1]):
        s += e[:, c]
    posterior = e / (s + eps)[:, None]
    return posterior, posterior.argmax(axis=1)


def gaussian_score(moments: DataFrame, fx: DataFrame, classes, pairs, n_features: int,
                   weights: DataFrame | None = None, w0: float = 1e-6, eps: float = 1e-10,
                   keep=("row_id", "y")) -> DataFrame:
    """ll(row,c) = sum_pairs -1/2 d^T (Sigma + 1e-6 I)^-1 d + ln(w + eps),
    no log-determinant (the reference's form).

    The moments table has C*P rows (bounded by the schema), so it is broadcast; a
    task sums its rows' pairs as one quadratic form a class (``QuadraticForms``)."""
    C = len(classes)
    m = moments.select("y", "pair_id", "m1", "m2", (F.col("c11") + 1e-6).alias("a11"), F.col("c12").alias("a12"),
                       (F.col("c22") + 1e-6).alias("a22"))
    if weights is not None:
        m = m.join(weights.select("y", "pair_id", "w"), ["y", "pair_id"], "left")
        wcol = F.coalesce(F.col("w"), F.lit(w0))
    else:
        wcol = F.lit(w0)
    det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
    m = m.select(
        F.col("y").alias("cls"),
        "pair_id",
        "m1",
        "m2",
        (F.col("a22") / det).alias("q11"),
        (-F.col("a12") / det).alias("q12"),
        (F.col("a11") / det).alias("q22"),
        F.ln(wcol + F.lit(eps)).alias("lw"),
    )
    found = m.where("m1 IS NOT NULL AND m2 IS NOT NULL AND q11 IS NOT NULL AND q12 IS NOT NULL AND q22 IS NOT NULL AND lw IS NOT NULL")
    told = moments.sparkSession.sparkContext.broadcast(QuadraticForms(found.toArrow(), None if pairs is None else list(pairs), n_features, C))
    x = F.col("x").cast("array<double>")
    # all pairs: a row has those of the values it holds, none of less than two
    rows = fx.where(F.size("x") >= 2) if pairs is None else fx
    kind = rows.select(*keep, x.alias("x")).schema
    made = StructType([*kind.fields[:-1], StructField("s", ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                s, any_ = told.value.sums(_values(part.column(len(kept)), n_features))
                offsets = pa.array(np.arange(0, s.size + 1, C, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(s.ravel(), mask=~any_.ravel()))], names=made.names)

    kept = list(keep)
    sums = rows.select(*keep, x.alias("x")).mapInArrow(run, made)
    g = sums.groupBy(*keep).agg(*[F.sum(F.col("s")[c]).alias(f"s{c}") for c in range(C)])
    ll = F.array(*[F.col(f"s{c}") for c in range(C)])
    return posterior_columns(g.select(*keep, ll.alias("ll")), eps)


def _values(col: pa.Array, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, there): the first ``n_features`` values of every row, zero where there is none."""
    out, there = np.zeros((len(col), n_features)), np.zeros((len(col), n_features), bool)
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    row = np.repeat(np.arange(len(col)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = place < n_features
    out[row[own], place[own]] = np.where(flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)[own]
    there[row[own], place[own]] = flat.is_valid().to_numpy(zero_copy_only=False)[own]
    return out, there


class QuadraticForms:
    """The Gaussian terms of all pairs of a class as one form over the features.

    A pair adds -(q11 d1^2 + 2 q12 d1 d2 + q22 d2^2) / 2 + lw where both values are there.  Where a
    feature has one mean in all its pairs the sum over pairs is a product of small matrices; rows with
    NaN or infinite values, and classes with several means of a feature, are added pair by pair."""

    def __init__(self, table: pa.Table, pairs, n_features: int, n_classes: int):
        pid = table.column("pair_id").to_numpy()
        if pairs is None:
            i, j = unrank_pairs(pid, n_features)
        else:
            i, j = np.array(pairs, np.int64).reshape(-1, 2)[pid].T
        cls = table.column("cls").to_numpy()
        col = {c: table.column(c).to_numpy() for c in ("m1", "m2", "q11", "q12", "q22", "lw")}
        self.terms = [(i[cls == c], j[cls == c], {k: v[cls == c] for k, v in col.items()}) for c in range(n_classes)]
        self.forms = []
        for i, j, t in self.terms:
            mean = np.full(n_features, np.nan)
            mean[i], mean[j] = t["m1"], t["m2"]
            one = bool(np.all(mean[i] == t["m1"]) and np.all(mean[j] == t["m2"])) and all(np.isfinite(v).all() for v in t.values())
            own, cross, const, has = (np.zeros((n_features, n_features)) for _ in range(4))
            if one:
                np.add.at(own, (i, j), t["q11"])  # weight of d_i^2 where j is there
                np.add.at(own, (j, i), t["q22"])
                for m, v in ((cross, t["q12"]), (const, t["lw"]), (has, np.ones(len(i)))):
                    np.add.at(m, (i, j), v)
            self.forms.append((one, np.nan_to_num(mean), own, cross, const, has))

    def sums(self, values: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sums, any): per row and class the sum of the terms, and whether there was one."""
        x, there = values
        out, some = np.zeros((len(x), len(self.terms))), np.zeros((len(x), len(self.terms)), bool)
        odd = np.flatnonzero(~np.isfinite(x).all(axis=1))
        p, clean = there.astype(float), np.where(np.isfinite(x), x, 0.0)
        for c, (one, mean, own, cross, const, has) in enumerate(self.forms):
            if one:
                d = np.where(there, clean - mean, 0.0)
                quad = ((d * d) * (p @ own.T)).sum(axis=1) + 2.0 * (d * (d @ cross.T)).sum(axis=1)
                out[:, c] = -0.5 * quad + (p * (p @ const.T)).sum(axis=1)
                some[:, c] = (p * (p @ has.T)).sum(axis=1) > 0
            i, j, t = self.terms[c]
            for r in odd if one else range(len(x)):
                both = there[r, i] & there[r, j]
                with np.errstate(invalid="ignore", over="ignore"):
                    d1, d2 = x[r, i] - t["m1"], x[r, j] - t["m2"]
                    each = -0.5 * (t["q11"] * d1 * d1 + 2.0 * t["q12"] * d1 * d2 + t["q22"] * d2 * d2) + t["lw"]
                    out[r, c], some[r, c] = each[both].sum(), both.any()
        return out, some
