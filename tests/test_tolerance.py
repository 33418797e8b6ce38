"""Tolerance matches on hot buckets and equal vectors against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbayes.operators import match


def close(s, p, atol=1e-5, rtol=1e-5):
    return len(s) == len(p) and all(a is not None and b is not None and abs(a - b) <= atol + rtol * abs(b) for a, b in zip(s, p))


@pytest.mark.parametrize("pairs,normalize", [(1 << 18, False), (50, False), (1, False), (50, True)])
def test_hot_first_element(spark, monkeypatch, pairs, normalize):
    monkeypatch.setattr(match, "GROUP_PAIRS", pairs)
    monkeypatch.setattr(match, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(4)
    base = np.round(rng.normal(size=(40, 4)) * [0, 1, 100, 1e-3] + [1, 0, 0, 0], 6)  # one first element for all
    near = base[rng.integers(0, 40, 120)] + rng.choice([0, 1e-6, 9e-6, 1.1e-5, 3e-5], size=(120, 4)) * rng.choice([-1, 1], size=(120, 4))
    dense = np.array([1.0, 0.5, 0.5, 0.5]) + rng.uniform(-8e-6, 8e-6, size=(60, 4))  # distinct, all in one place
    src = [("s%d" % i, int(i % 2), v.tolist()) for i, v in enumerate(np.vstack([base, dense[:30]]))]
    prd = [(i, int(i % 2), v.tolist(), int(i % 3)) for i, v in enumerate(np.vstack([near, dense[30:], base]))]
    src += [("null", 0, None), ("nolabel", None, [1.0] * 4), ("gap", 0, [1.0, None, 0.0, 0.0]), ("short", 0, [1.0, 0.0])]
    prd += [(900, 0, None, 1), (901, 0, [1.0, 0.0], 2), (902, 0, [1.0, None, 0.0, 0.0], 2)]
    s = spark.createDataFrame(src, "s_name string, label int, sv array<double>")
    p = spark.createDataFrame(prd, "row_id long, label int, pv array<double>, cls int")
    unit = (lambda v: [x / np.sqrt(sum(y * y for y in v)) for x in v]) if normalize else (lambda v: v)
    ok = lambda a, b: a[1] is not None and a[1] == b[1] and a[2] and b[2] and None not in a[2] and None not in b[2] and close(unit(a[2]), unit(b[2]))
    want = sorted((a[0], b[0]) for a in src for b in prd if ok(a, b))
    got = match.tolerance_join_cols(s, p, "label", "sv", "pv", normalize=normalize)
    assert set(got.columns) == {"s_name", "label", "sv", "row_id", "pv", "cls"}
    assert sorted((r.s_name, r.row_id) for r in got.collect()) == want and len(want) > 300
    votes = {r.s_name: (r.winner, r.total, r.winner_votes) for r in match.tolerance_vote(s, p, "label", "sv", "pv", "s_name", "cls", "row_id", normalize=normalize).collect()}
    plain = {r.s_name: (r.winner, r.total, r.winner_votes) for r in match.majority_vote(got, "s_name", "cls", "row_id").collect()}
    assert votes == plain and {k: v[1] for k, v in votes.items()} == Counter(a for a, _ in want)


def test_ten_thousand_equal_spectra(spark):
    rows = spark.range(10_000).select("id", F.lit(1).alias("label"), F.array(*[F.lit(float(v)) for v in (3, 4, 0)]).alias("x"))
    s = rows.select(F.concat(F.lit("s"), "id").alias("s_name"), "label", F.col("x").alias("sv"))
    p = rows.select(F.col("id").alias("row_id"), "label", F.col("x").alias("pv"), (F.col("id") % 3).cast("int").alias("cls"))
    nodes = match.tolerance_nodes(s, "label", "sv"), match.tolerance_nodes(p, "label", "pv")
    assert [n.count() for n in nodes] == [1, 1] and match.tolerance_links(*nodes).count() == 1
    v = match.tolerance_vote(s, p, "label", "sv", "pv", "s_name", "cls", "row_id")
    assert v.count() == 10_000 and [tuple(r) for r in v.select("winner", "total", "winner_votes").distinct().collect()] == [(0, 10_000, 3334)]


def test_no_spectra(spark):
    none = spark.createDataFrame([], "s_name string, label int, sv array<double>")
    p = spark.createDataFrame([(1, 1, [1.0], 2)], "row_id long, label int, pv array<double>, cls int")
    assert match.tolerance_join_cols(none, p, "label", "sv", "pv").collect() == []
    assert match.tolerance_join_cols(none.selectExpr("s_name", "label", "sv"), p.limit(0), "label", "sv", "pv").collect() == []


def test_the_norm_is_worked_out_once_a_row(spark):
    from pairbayes.functions.columns import l2_normalize

    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([1.0, None],)]
    df = spark.createDataFrame(rows, "x array<float>").select(l2_normalize(F.col("x")).alias("u"))
    # in the lambda of the elements an aggregate over all of them would make the work quadratic
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None, [None, None]]
