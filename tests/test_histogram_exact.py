"""XOR and small fixtures: exact counts and posteriors computed by hand /
by an independent numpy implementation of the score and the boost."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbayes.operators.binning import BinSpec, edges_from_minmax, explode_cells, bin_rows
from pairbayes.operators.boost import failed_rows, merge_weights, weight_deltas
from pairbayes.operators.likelihood import fit_histogram, probabilities
from pairbayes.operators.posterior import score
from pairbayes.plans.train import train, TrainLog

XOR = [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)] * 3


def _fx(spark, rows):
    data = [(i, str(t), [float(a), float(b)]) for i, (a, b, t) in enumerate(rows)]
    fx = spark.createDataFrame(data, "row_id long, label string, x array<double>")
    return fx.withColumn("y", F.col("label").cast("int"))


def test_xor_counts_and_posterior(spark):
    fx = _fx(spark, XOR)
    spec = edges_from_minmax([0.0, 0.0], [1.0, 1.0], 2)
    m = fit_histogram(fx, spec, ["0", "1"], None, 2)
    counts = {(r.y, r.bi, r.bj): r.n for r in m.counts.collect()}
    # class 0 occupies (0,0) and (1,1) three times each; class 1 the other two
    assert counts == {(0, 0, 0): 3, (0, 1, 1): 3, (1, 0, 1): 3, (1, 1, 0): 3}
    p = {(r.y, r.bi, r.bj): r.p for r in probabilities(m).collect()}
    assert p[(0, 0, 0)] == pytest.approx(4 / (6 + 4 + 1e-8))
    s = {r.row_id: r for r in score(m, fx).collect()}
    # by hand: ll_c = ln(p*w0 + eps) for one pair; occupied p=4/10, empty 1/10
    occ = math.log(0.4 * 1e-6 + 1e-10)
    emp = math.log(0.1 * 1e-6 + 1e-10)
    e = math.exp(emp - occ)
    expect = 1.0 / (1.0 + e + 1e-10)
    for rid, (a, b, t) in enumerate(XOR):
        assert s[rid].pred == t
        assert s[rid].posterior[t] == pytest.approx(expect, rel=1e-9)


def _numpy_score(X, y, lo, w, B, pairs, weights, C, w0=1e-6, eps=1e-10):
    bins = np.clip(np.ceil((X - lo) / w).astype(int) - 1, 0, B - 1)
    nc = np.array([(y == c).sum() for c in range(C)])
    ll = np.zeros((len(X), C))
    for k, (i, j) in enumerate(pairs):
        cnt = np.zeros((C, B, B))
        for r in range(len(X)):
            cnt[y[r], bins[r, i], bins[r, j]] += 1
        prob = (cnt + 1) / (nc[:, None, None] + B * B + 1e-8)
        W = weights[k]
        ll += np.log(prob[:, bins[:, i], bins[:, j]].T * W[:, bins[:, i], bins[:, j]].T + eps)
    m = ll.max(axis=1, keepdims=True)
    e = np.exp(ll - m)
    post = e / (e.sum(axis=1, keepdims=True) + eps)
    return post, bins, prob if False else None


def test_numpy_crosscheck_score_and_boost(spark):
    rng = np.random.default_rng(3)
    n, nf, B, C = 120, 3, 4, 3
    X = rng.normal(size=(n, nf))
    y = rng.integers(0, C, size=n)
    data = [(i, str(int(y[i])), [float(v) for v in X[i]]) for i in range(n)]
    fx = spark.createDataFrame(data, "row_id long, label string, x array<double>").withColumn("y", F.col("label").cast("int"))
    spec = edges_from_minmax(list(X.min(0)), list(X.max(0)), B)
    lo = np.array(spec.lo)
    w = np.array(spec.width)
    pairs = list(itertools.combinations(range(nf), 2))
    weights = [np.full((C, B, B), 1e-6) for _ in pairs]
    m = fit_histogram(fx, spec, ["0", "1", "2"], None, nf)
    post_np, bins, _ = _numpy_score(X, y, lo, w, B, pairs, weights, C)
    s = {r.row_id: r for r in score(m, fx).collect()}
    for i in range(n):
        np.testing.assert_allclose(s[i].posterior, post_np[i], rtol=1e-9, atol=1e-12)
    # one boost step by numpy (lr already halved: 0.05) vs Spark
    pred = post_np.argmax(1)
    nc = np.array([(y == c).sum() for c in range(C)])
    for k, (a, b) in enumerate(pairs):
        cnt = np.zeros((C, B, B))
        for r in range(n):
            cnt[y[r], bins[r, a], bins[r, b]] += 1
        prob = (cnt + 1) / (nc[:, None, None] + B * B + 1e-8)
        for r in np.nonzero(pred != y)[0]:
            if prob[pred[r], bins[r, a], bins[r, b]] < 0.25:
                weights[k][y[r], bins[r, a], bins[r, b]] += 0.05 * (1 - post_np[r, y[r]] / post_np[r, pred[r]])
    m2 = train(m, fx, epochs=1, patience=5, log=TrainLog())
    got = {(r.y, r.pair_id, r.bi, r.bj): r.w for r in m2.weights.collect()}
    for k in range(len(pairs)):
        for c in range(C):
            for i in range(B):
                for j in range(B):
                    expect = weights[k][c, i, j]
                    assert got.get((c, k, i, j), 1e-6) == pytest.approx(expect, rel=1e-9)
    post2, _, _ = _numpy_score(X, y, lo, w, B, pairs, weights, C)
    s2 = {r.row_id: r for r in score(m2, fx).collect()}
    for i in range(n):
        np.testing.assert_allclose(s2[i].posterior, post2[i], rtol=1e-7, atol=1e-10)


def test_invariants(spark):
    rng = np.random.default_rng(5)
    n, nf, B = 200, 4, 8
    X = rng.normal(size=(n, nf))
    y = rng.integers(0, 2, size=n)
    data = [(i, str(int(y[i])), [float(v) for v in X[i]]) for i in range(n)]
    fx = spark.createDataFrame(data, "row_id long, label string, x array<double>").withColumn("y", F.col("label").cast("int"))
    spec = edges_from_minmax(list(X.min(0)), list(X.max(0)), B)
    m = fit_histogram(fx, spec, ["0", "1"], None, nf)
    # probabilities over all B^2 cells sum to 1 per (class, pair)
    p = probabilities(m).groupBy("y", "pair_id").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("k")).collect()
    p0 = m.p0()
    for r in p:
        assert r.s + (B * B - r.k) * p0[r.y] == pytest.approx(1.0, abs=1e-7)
    # bins in range
    b = bin_rows(fx, spec, keep=("row_id",)).select(F.explode("b").alias("v")).agg(F.min("v"), F.max("v")).collect()[0]
    assert b[0] >= 0 and b[1] <= B - 1
    # posteriors sum to 1
    s = score(m, fx).select(F.aggregate("posterior", F.lit(0.0), lambda a, v: a + v).alias("t")).collect()
    assert all(abs(r.t - 1.0) < 1e-8 for r in s)
    # counts add over splits
    a = fit_histogram(fx.where("row_id % 2 = 0"), spec, ["0", "1"], None, nf).counts
    c = fit_histogram(fx.where("row_id % 2 = 1"), spec, ["0", "1"], None, nf).counts
    merged = a.unionByName(c).groupBy("y", "pair_id", "bi", "bj").agg(F.sum("n").alias("n"))
    assert merged.exceptAll(m.counts).count() == 0 and m.counts.exceptAll(merged).count() == 0
    # old + delta = new
    sc = score(m, fx, with_bins=True)
    d = weight_deltas(m, failed_rows(sc, 0.05))
    w1 = merge_weights(m, d)
    m1 = m.with_weights(w1)
    w2 = merge_weights(m1, d)
    k = ["y", "pair_id", "bi", "bj"]
    j = (w1.withColumnRenamed("w", "w1").join(w2.withColumnRenamed("w", "w2"), k).join(d, k)
         .select((F.col("w2") - F.col("w1") - F.col("dw")).alias("z")).collect())
    assert len(j) > 0
    assert all(abs(r.z) < 1e-12 for r in j)


def test_missing_values_get_missing_bin(spark):
    fx = spark.createDataFrame([(0, "a", [None, 1.0]), (1, "b", [float("nan"), 2.0]), (2, "a", [0.5, 3.0])],
                               "row_id long, label string, x array<double>")
    spec = edges_from_minmax([0.5, 1.0], [0.5, 3.0], 4)
    b = {r.row_id: r.b for r in bin_rows(fx, spec, keep=("row_id",)).collect()}
    assert b[0][0] == -1 and b[1][0] == -1 and b[2][0] >= 0


def test_two_step_pair_explosion_equals_listed_pairs(spark):
    """Wide inputs use the two-step explode; it must equal the listed-pairs path."""
    rng = np.random.default_rng(11)
    n, nf = 40, 30  # 435 pairs: above the codegen-array size
    X = rng.normal(size=(n, nf))
    data = [(i, int(i % 3), [float(v) for v in X[i]]) for i in range(n)]
    fx = spark.createDataFrame(data, "row_id long, y int, x array<double>")
    spec = edges_from_minmax(list(X.min(0)), list(X.max(0)), 8)
    b = bin_rows(fx, spec, keep=("row_id", "y"))
    a = explode_cells(b, None, nf)
    c = explode_cells(b, list(itertools.combinations(range(nf), 2)), nf)
    assert a.count() == n * nf * (nf - 1) // 2
    assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0
    from pairbayes.operators.likelihood import class_moments

    m1 = class_moments(fx, None, nf).orderBy("y", "pair_id").collect()
    m2 = class_moments(fx, list(itertools.combinations(range(nf), 2)), nf).orderBy("y", "pair_id").collect()
    assert len(m1) == len(m2)
    for r1, r2 in zip(m1, m2):
        assert (r1.y, r1.pair_id, r1.n) == (r2.y, r2.pair_id, r2.n)
        assert r1.c12 == pytest.approx(r2.c12, rel=1e-9, abs=1e-12)
