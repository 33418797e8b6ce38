"""Scores, weight changes and counts by lookup: brute force, and no row for each row and pair."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbayes.operators import lookup
from pairbayes.operators.binning import edges_from_minmax
from pairbayes.operators.boost import weight_deltas
from pairbayes.operators.likelihood import class_moments, fit_counts, fit_histogram
from pairbayes.operators.posterior import gaussian_score, log_likelihoods

NF, B = 4, 5
KIND = "row_id long, y int, x array<double>"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = [(i, i % 3, [None if rng.random() < 0.1 else float(v) for v in rng.normal(i % 3, 2, NF)]) for i in range(60)]
    return out + [out[7], out[7], (70, 1, [None] * NF), (71, 2, [float("nan"), 1.0, 0.5, 2.0]), (72, 0, [float("inf"), 1.0, None, 2.0])]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def model_of(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    return fit_histogram(df, edges_from_minmax([-5.0] * NF, [7.0] * NF, B), ("a", "b", "c"), None, NF), df


@pytest.mark.parametrize("limit", [1 << 26, 1])
def test_scores(spark, rows, limit):
    model, df = model_of(spark, rows)
    table = {(r.pair_id, r.bi, r.bj): r.d for r in log_table(model).collect()}
    bins = lambda x: [-1 if v is None or math.isnan(v) else max(0, min(B - 1, math.ceil(min((v - lo) / w, 1e9)) - 1)) for v, lo, w in zip(x, model.spec.lo, model.spec.width)]
    found = log_likelihoods(model, df, limit=limit)
    assert "Generate" not in plan(found)
    got = {r.row_id: r.ll for r in found.collect()}
    assert len(got) == 63
    base = [6 * math.log(p * model.w0 + model.eps) for p in model.p0()]
    for i, y, x in rows:
        b, times = bins(x), sum(r[0] == i for r in rows)
        s = [base[c] + times * sum(table.get((k, b[f], b[g]), [0.0] * 3)[c] for k, (f, g) in enumerate(itertools.combinations(range(NF), 2))) for c in range(3)]
        assert got[i] == pytest.approx(s, abs=1e-9)


def log_table(model):
    from pairbayes.operators.likelihood import model_table

    return model_table(model)


def test_unique_rows_need_no_shuffle(spark, rows):
    model, df = model_of(spark, rows[:60])
    a, b = log_likelihoods(model, df), log_likelihoods(model, df, unique=True)
    assert "Aggregate" in plan(a) and "Aggregate" not in plan(b)
    assert {r.row_id: pytest.approx(r.ll, abs=1e-9) for r in a.collect()} == {r.row_id: r.ll for r in b.collect()}


@pytest.mark.parametrize("rule", ["threshold", "bin_overlap"])
def test_weight_changes(spark, rows, rule):
    model, df = model_of(spark, rows)
    table = {(r.pair_id, r.bi, r.bj): r.p for r in log_table(model).collect()}
    occupied = {(r.y, r.pair_id, r.bi, r.bj) for r in model.counts.collect()}
    failed = [(i % 3, (i + 1) % 3, [i % 6 - 1, i % 5, -1, (i * i) % 5], 0.25 + i) for i in range(40)]
    want: dict = {}
    for y, pred, b, adj in failed:
        for k, (f, g) in enumerate(itertools.combinations(range(NF), 2)):
            cell = (k, b[f], b[g])
            if (table.get(cell, model.p0())[pred] < 0.05) if rule == "threshold" else (pred, *cell) not in occupied:
                want[(y, *cell)] = want.get((y, *cell), 0.0) + adj
    found = weight_deltas(model, spark.createDataFrame(failed, "y int, pred int, b array<int>, adj double"), 0.05, rule)
    assert "Generate" not in plan(found)
    assert {(r.y, r.pair_id, r.bi, r.bj): r.dw for r in found.collect()} == pytest.approx(want)


@pytest.mark.parametrize("pairs", [None, [(0, 1), (1, 3)]])
def test_gaussian_scores(spark, rows, pairs):
    df = spark.createDataFrame(rows, KIND)
    moments = class_moments(spark.createDataFrame(rows[:60], KIND), pairs, NF)
    m = {(r.y, r.pair_id): r for r in moments.collect()}
    found = gaussian_score(moments, df, ("a", "b", "c"), pairs, NF)
    assert "Generate" not in plan(found)
    got = {r.row_id: r.ll for r in found.collect()}
    assert len(got) == 63
    lw = math.log(1e-6 + 1e-10)
    for i, _, x in rows:
        times = sum(r[0] == i for r in rows)
        for c in range(3):
            s = []
            for k, (f, g) in enumerate(pairs or itertools.combinations(range(NF), 2)):
                if x[f] is None or x[g] is None:
                    continue
                r = m[(c, k)]
                a11, a12, a22 = r.c11 + 1e-6, r.c12, r.c22 + 1e-6
                det, d1, d2 = a11 * a22 - a12 * a12, x[f] - r.m1, x[g] - r.m2
                s.append(-0.5 * (a22 / det * d1 * d1 - 2 * a12 / det * d1 * d2 + a11 / det * d2 * d2) + lw)
            if s:
                assert got[i][c] == pytest.approx(times * sum(s), rel=1e-9, nan_ok=True)
            else:
                assert got[i][c] is None


@pytest.mark.parametrize("most", [1 << 21, 1])
def test_task_counts(spark, rows, monkeypatch, most):
    model, df = model_of(spark, rows)
    monkeypatch.setattr(lookup, "STEP", 8)
    monkeypatch.setattr(lookup, "MOST_CELLS", most)
    from pairbayes.streaming.state import running_counts

    found = running_counts(df, model)
    assert "Generate" not in plan(found)
    key = lambda d: {(r.y, r.pair_id, r.bi, r.bj): r.n for r in d.collect()}
    assert key(found) == key(fit_counts(df, model.spec, None, NF, 3))
