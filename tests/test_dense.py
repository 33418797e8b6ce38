"""Dense pair counts against a plain grouping, and the pair numbering."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbayes.operators import dense
from pairbayes.operators.binning import bin_rows, edges_from_minmax, explode_cells
from pairbayes.operators.likelihood import fit_counts, fit_histogram, model_table


@pytest.mark.parametrize("n", [2, 3, 7, 64])
def test_unranking_inverts_the_pair_order(n):
    pairs = list(itertools.combinations(range(n), 2))
    i, j = dense.unrank_pairs(np.arange(len(pairs)), n)
    assert list(zip(i.tolist(), j.tolist())) == pairs


def test_unranking_of_many_features():
    n = 200_000
    total = n * (n - 1) // 2
    k = np.unique(np.r_[0, n - 2, n - 1, total - 1, np.random.default_rng(1).integers(0, total, 2000)])
    i, j = dense.unrank_pairs(k, n)
    assert ((0 <= i) & (i < j) & (j < n)).all()
    assert [int(a) * n - int(a) * (int(a) + 1) // 2 + int(b) - int(a) - 1 for a, b in zip(i, j)] == k.tolist()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 5)).round(2)
    data = [(i, int(rng.integers(0, 4)) if i % 50 else None, [None if rng.random() < 0.05 else (float("nan") if rng.random() < 0.05 else float(v)) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame([*data, (9999, 1, None)], "row_id long, y int, x array<double>").repartition(5).cache()


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 4 * 1024}, {"BLOCK_BYTES": 64}, {"GROUP_ROWS": 100}, {"CHUNK_ROWS": 7, "GROUP_ROWS": 300}])
@pytest.mark.parametrize("pairs", [None, [(0, 4), (1, 2), (3, 3)]])
def test_counts_equal_a_plain_grouping(monkeypatch, rows, limits, pairs):
    for name, value in limits.items():
        monkeypatch.setattr(dense, name, value)
    spec = edges_from_minmax([-2.0] * 5, [2.5] * 5, 6)
    plain = explode_cells(bin_rows(rows.where("x IS NOT NULL AND y IS NOT NULL"), spec, keep=("y",)), pairs, 5, keep=("y",))
    want = {tuple(r) for r in plain.groupBy("y", "pair_id", "bi", "bj").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pairs = 10 if pairs is None else 3
    whole = rows.where("x IS NOT NULL")
    assert {tuple(r) for r in fit_counts(whole, spec, pairs, 5, 4, 900).collect()} == want
    # a row without features has every feature missing
    extra = {(r.y, r.pair_id, r.bi, r.bj): r.n for r in fit_counts(rows, spec, pairs, 5, 4, 900).collect()}
    assert sum(extra.values()) == sum(w[-1] for w in want) + n_pairs


def test_model_table_is_the_same_from_cells_and_counts(rows):
    from dataclasses import replace

    spec = edges_from_minmax([-2.0] * 5, [2.5] * 5, 6)
    model = fit_histogram(rows, spec, list("abcd"), None, 5)
    a = {(r.pair_id, r.bi, r.bj): (r.p, r.d) for r in model_table(model).collect()}
    b = {(r.pair_id, r.bi, r.bj): (r.p, r.d) for r in model_table(replace(model, cells=None, _table=None)).collect()}
    assert a.keys() == b.keys()
    assert all(math.isclose(u, v, rel_tol=1e-12, abs_tol=1e-12) for k in a for s, t in zip(a[k], b[k]) for u, v in zip(s, t))


def test_nothing_to_count(spark):
    spec = edges_from_minmax([0.0] * 3, [1.0] * 3, 4)
    assert fit_counts(spark.createDataFrame([], "y int, x array<double>"), spec, None, 3, 2).collect() == []


@pytest.mark.parametrize("n,most", [(2, None), (7, None), (30, 100), (64, 300), (5, 10), (3, 1)])
def test_pair_table_and_list_agree(spark, n, most):
    from pairbayes.operators.binning import feature_pairs, pair_of, pairs_table

    every = list(itertools.combinations(range(n), 2))
    assert [pair_of(k, n) for k in range(len(every))] == every
    rows = pairs_table(spark, n, most).collect()
    assert sorted((r.f1, r.f2) for r in rows) == feature_pairs(n, most)
    assert all(every[r.pair_id] == (r.f1, r.f2) for r in rows)
    assert len(set(rows)) == len(rows) == (len(every) if most is None else min(most, len(every)))


def test_many_features_need_no_list(spark):
    from pairbayes.operators.binning import given_pairs, pair_of, pairs_table

    table = pairs_table(spark, 5000, 1000, seed=7)
    assert len(table._jdf.queryExecution().analyzed().toString()) < 20_000
    rows = table.collect()
    assert len({r.pair_id for r in rows}) == 1000 and all(pair_of(r.pair_id, 5000) == (r.f1, r.f2) for r in rows)
    assert max(r.f1 for r in rows) > 4000 and min(r.f1 for r in rows) < 100
    assert given_pairs([(3, 1), (1, 3), (0, 2)]) == [(0, 2), (1, 3)]
