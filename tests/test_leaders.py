"""Greedy leaders and class diameters against a sequential walk over a dense matrix."""

import itertools

import numpy as np
import pytest

from pairbayes.operators.leaders import diameters, leaders


def matrix(x, pairs):
    d = x[:, None, :] - x[None, :, :]
    return np.mean([np.sqrt(d[..., i] ** 2 + d[..., j] ** 2) for i, j in pairs], axis=0)


def walked(ids, x, limit, pairs):
    """The rule as a loop: rows in id order, clusters from a matrix divided by its largest value."""
    order = np.argsort(ids)
    ids, d = ids[order], matrix(x[order], pairs) / len(pairs)
    if d.max() > 0:
        d = d / (d.max() + 1e-7)
    seen, out = np.zeros(len(ids), bool), set()
    for i in range(len(ids)):
        if not seen[i]:
            members = np.flatnonzero(d[i] < limit)
            out.add((int(ids[members[0]]), int(ids[i])))
            seen[members] = True
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 4)) * [1, 5, 0.1, 2]
    x[100:160] = x[99]  # equal rows
    x[200:300] = x[200] + rng.normal(size=(100, 4)) * 0.01  # a dense place
    x[400:450, 0] = np.arange(50) * 0.2  # ids along a line
    y = rng.integers(0, 3, 500)
    y[490:] = 7
    x[490:] = 1.0  # a class of equal rows
    return rng.permutation(500) * 3, y, x


@pytest.mark.parametrize("parts,prefix", [(1, None), (7, None), (5, 16), (3, 1)])
def test_leaders_equal_the_walk(spark, data, parts, prefix):
    ids, y, x = data
    keep = slice(None) if prefix != 1 else slice(200, 320)
    ids, y, x = ids[keep], y[keep], x[keep]
    pairs = list(itertools.combinations(range(4), 2))
    rows = [(int(i), int(c), v.tolist()) for i, c, v in zip(ids, y, x)]
    df = spark.createDataFrame([*rows, rows[0], (10**6, None, [0.0] * 4)], "row_id long, y int, x array<double>").repartition(parts)
    got = {(r.y, r.row_id, r.leader) for r in leaders(df, 4, 0.1, prefix=prefix).collect()}
    want = {(int(c), *t) for c in np.unique(y) for t in walked(ids[y == c], x[y == c], 0.1, pairs)}
    assert got == want
    assert len(want) > 8


def test_given_pairs_missing_values_and_diameter(spark, data):
    ids, y, x = data
    pairs = [(0, 1), (1, 3)]
    rows = [(int(i), int(c), v.tolist()) for i, c, v in zip(ids, y, x)]
    rows += [(10**6, 0, None), (10**6 + 1, 0, [None, 1.0, 2.0, float("nan")])]
    filled = np.vstack([x, [-99999.0] * 4, [-99999.0, 1.0, 2.0, -99999.0]])
    every = np.r_[ids, 10**6, 10**6 + 1], np.r_[y, 0, 0]
    df = spark.createDataFrame(rows, "row_id long, y int, x array<double>")
    got = {(r.y, r.row_id, r.leader) for r in leaders(df, 4, 0.2, pairs=pairs).collect()}
    assert got == {(int(c), *t) for c in np.unique(every[1]) for t in walked(every[0][every[1] == c], filled[every[1] == c], 0.2, pairs)}
    wide = diameters(spark.createDataFrame(rows[:500], "row_id long, y int, x array<double>"), 4, pairs)
    for c in np.unique(y):
        assert wide[int(c)] == pytest.approx(matrix(x[y == c], pairs).max(), abs=1e-12)


def test_nothing_to_walk(spark):
    assert leaders(spark.createDataFrame([], "row_id long, y int, x array<double>"), 3).collect() == []


def test_diameter_of_many_blocks(spark, monkeypatch):
    from pairbayes.operators import leaders as own

    monkeypatch.setattr(own, "FAR_BLOCK", 3)
    rng = np.random.default_rng(11)
    x = rng.normal(0, [1, 40, 3], (300, 3))
    rows = [(i, i % 2, x[i].tolist()) for i in range(len(x))]
    got = own.diameters(spark.createDataFrame(rows, "row_id long, y int, x array<double>"), 3)
    norm = own.PairNorm(3)
    for y in (0, 1):
        part = x[y::2]
        assert got[y] == max(norm.length(part - p).max() for p in part)


def test_selection_scores_rows_once(spark):
    from pyspark.sql import functions as F

    from pairbayes.operators.active import select_samples

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "row_id long, y int, posterior array<double>, confidence double, pred int, x array<double>"
    rows = [(i, i % 2, [0.4, 0.6] if i % 2 == 0 else [0.7, 0.3], 0.7 if i % 2 else 0.6, 1 - i % 2, [float(i), float(i * i % 7)]) for i in range(40)]
    df = spark.createDataFrame(rows, kind)
    scored = df.drop("x").mapInArrow(count, kind.rsplit(",", 1)[0])
    got = select_samples(scored, df.select("row_id", "x"), df.groupBy("y").agg(F.count(F.lit(1)).alias("n")), 2).collect()
    assert got and seen.value == 40
