"""Gram sums, components, the learned inverse and exact quantiles against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbayes.operators import embed, gram, inverse, quantiles
from pairbayes.operators.likelihood import class_moments


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + [0, 1e6, 0, 5, 0, 0]
    x[:, 5] = 3.0  # constant
    y = rng.integers(0, 3, 400)
    holes = rng.random(x.shape) < 0.05
    holes[:, 5] = False
    rows = [(i, int(y[i]) if i % 40 else None, [None if holes[i, f] else float(x[i, f]) for f in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, y int, x array<double>").repartition(4).cache()
    return df, np.array([-1 if i % 40 == 0 else y[i] for i in range(400)]), np.where(holes, np.nan, x)


@pytest.mark.parametrize("limits", [{}, {"STRIP": 2}, {"SUM_BYTES": 0, "STRIP": 4}])
@pytest.mark.parametrize("pairs", [None, [(0, 5), (1, 3)]])
def test_class_moments(monkeypatch, table, limits, pairs):
    for name, value in limits.items():
        monkeypatch.setattr(gram, name, value)
    df, y, x = table
    got = {(r.y, r.pair_id): r for r in class_moments(df, pairs, 6).collect()}
    listed = pairs or list(itertools.combinations(range(6), 2))
    assert got.keys() == {(c, k) for c in range(3) for k in range(len(listed))}
    for (c, k), r in got.items():
        a, b = (x[y == c][:, f] for f in listed[k])
        n, both = (y == c).sum(), ~np.isnan(a) & ~np.isnan(b)
        scale = (n - 1) / (n - 1 + 1e-6)
        assert r.n == n
        assert [r.m1, r.m2] == pytest.approx([np.nanmean(a), np.nanmean(b)], rel=1e-12)
        assert r.c11 == pytest.approx(np.nanvar(a, ddof=1) * scale + 1e-6, rel=1e-6)
        assert r.c22 == pytest.approx(np.nanvar(b, ddof=1) * scale + 1e-6, rel=1e-6)
        assert r.c12 == pytest.approx(np.cov(a[both], b[both])[0, 1] * scale, rel=1e-6, abs=1e-9)


def test_correlations(table):
    df, _, x = table
    got = {(r.f1, r.f2): r["corr"] for r in embed.feature_correlation(df, None, 6).collect()}
    for a, b in itertools.combinations(range(6), 2):
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        if b == 5:
            assert got[a, b] is None  # constant
        else:
            assert got[a, b] == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-8)
    assert {(r.f1, r.f2) for r in embed.feature_correlation(df, [(0, 2), (1, 4)], 6).collect()} == {(0, 2), (1, 4)}


def test_principal_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    x = np.c_[x, np.full(300, 7.0)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    m = gram.principal_components(df, 6, 3)
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert m.variance == pytest.approx((s**2 / (s**2).sum())[:3])
    for own, v in zip(m.loadings, vt):
        assert own == pytest.approx(v * np.sign(v[np.abs(v).argmax()]), abs=1e-9) and own[np.abs(own).argmax()] > 0
    got = {r.row_id: r.pc for r in gram.component_scores(df, m).collect()}
    assert np.array([got[i] for i in range(300)]) == pytest.approx(z @ m.loadings.T, abs=1e-9)
    scaled = embed.pca_scores(df, 2, 6).agg(F.min("pc1"), F.max("pc1"), F.min("pc2"), F.max("pc2")).first()
    assert tuple(scaled) == pytest.approx((-1, 1, -1, 1))


def test_learned_inverse_and_losses(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(3), 200)
    x = p @ rng.normal(size=(3, 4)) * 5 + 2 + rng.normal(size=(200, 4)) * 0.1
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(p, x))]
    df = spark.createDataFrame([*rows, (900, None, [1.0] * 4)], "row_id long, posterior array<double>, x array<double>")
    w = inverse.fit_inverse(df, 3, 4)
    z = np.c_[np.ones(200), p]
    a = z.T @ z + np.diag([0, 1, 1, 1])
    assert w == pytest.approx(np.linalg.solve(a, z.T @ x), abs=1e-6)
    rec = inverse.invert(df, w)
    assert rec.where("row_id = 900").first()["x_hat"] is None
    hat = z @ w
    e = {r.feature: r for r in inverse.feature_errors(rec.where("row_id < 900")).collect()}
    assert [e[f].mse for f in range(4)] == pytest.approx(((x - hat) ** 2).mean(axis=0))
    per_row = ((x - hat) ** 2).mean(axis=1)
    assert (e[-1].mse, e[-1]["std"]) == pytest.approx((per_row.mean(), per_row.std(ddof=1)))
    lo, g = x.min(axis=0), np.ptp(x, axis=0)
    sx, sh = (x - lo) / g, (hat - lo) / g
    cx, ch = sx - sx.mean(axis=0), sh - sh.mean(axis=0)
    corr = -(cx * ch).sum(axis=1) / (np.linalg.norm(cx, axis=1) * np.linalg.norm(ch, axis=1) + 1e-8)
    a, b = sx.std(axis=0, ddof=1) + 1e-8, sh.std(axis=0, ddof=1) + 1e-8
    kl = (np.log(b / a) + (a**2 + (sx.mean(axis=0) - sh.mean(axis=0)) ** 2) / (2 * b**2) - 0.5).mean()
    got = inverse.losses(rec).first()
    assert (got.mse, got["corr"], got.kl) == pytest.approx((((sx - sh) ** 2).mean(), corr.mean(), kl))
    assert got.total == pytest.approx(got.mse + 0.1 * got["corr"] + 0.01 * got.kl)


def test_zero_and_empty_vectors(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 1, [1.0, 2.0]), (3, 1, [None, 1.0])], "row_id long, y int, x array<double>")
    assert embed.class_mean_cosine(df).first()["cosine"] == 0.0
    only = spark.createDataFrame([(1, 0, [None, 1.0]), (2, 1, [1.0, 2.0])], "row_id long, y int, x array<double>")
    assert embed.class_means_matrix(only, 2, 2) == [[0.0, 1.0], [1.0, 2.0]]
    empty = spark.createDataFrame([([], [])], "x array<double>, x_hat array<double>")
    assert embed.reconstruction_errors(empty).first()["mse"] is None and inverse.row_errors(empty).first()["mse"] is None


@pytest.mark.parametrize("few,bins", [(4096, 1024), (0, 4), (5, 16)])
def test_quantiles(spark, monkeypatch, few, bins):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(3)
    data = {("a", 1): rng.lognormal(0, 3, 800), ("a", None): np.round(rng.normal(size=300), 1), (None, 1): np.full(50, 2.5), ("b", 2): np.array([7.0]), ("c", 2): np.r_[-1e300, rng.normal(size=60), 1e300, 1e-300]}
    rows = [(*k, float(v)) for k, vs in data.items() for v in vs] + [("a", 1, None), ("a", 1, float("nan")), ("z", 9, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(6)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.h, r.p): r.q for r in quantiles.exact_quantiles(df, ["g", "h"], "v", ps).collect()}
    assert got.keys() == {(*k, p) for k in data for p in ps}
    for (g, h, p), q in got.items():
        assert q == pytest.approx(np.quantile(data[g, h], p), rel=1e-9)
    plan = quantiles.exact_quantiles(df, ["g", "h"], "v", ps)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    whole = quantiles.wide_quantiles(df, [], "v", [0.5], "p").first()
    assert whole["p50"] == pytest.approx(np.median(np.concatenate(list(data.values()))))


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g int, v double"), ["g"], "v", [0.5]).collect() == []


def test_few_groups_deal_no_rows_by_key(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from pairbayes.operators import quantiles

    rows = spark.range(20_000).selectExpr("IF(id % 3 = 2, NULL, id % 3) AS g", "CAST(id * 7919 % 20011 AS DOUBLE) AS v")
    plans, cut = [], quantiles.cut_lineage
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    told = {(r.g, r.p): r.q for r in quantiles.exact_quantiles(rows, ["g"], "v", [0.0, 0.5, 0.77]).collect()}
    assert isinstance(rows, DataFrame) and any("BroadcastHashJoin" in p for p in plans)
    assert not any("SortMergeJoin" in p and "Range (0, 20000" in p for p in plans)
    monkeypatch.setattr(quantiles, "TOLD", 0)
    assert {(r.g, r.p): r.q for r in quantiles.exact_quantiles(rows, ["g"], "v", [0.0, 0.5, 0.77]).collect()} == told and len(told) == 9
