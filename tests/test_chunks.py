"""Rows kept as chunks: the same scores, leaders and rounds as from plain rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbayes.operators import chunks
from pairbayes.operators.active import failed_by_margin, failed_chunks, largest_margins, widest_margins
from pairbayes.operators.leaders import diameters, leaders, leaders_of_chunks
from pairbayes.operators.likelihood import fit_histogram
from pairbayes.operators.posterior import score
from pairbayes.plans import train as plan

KIND = "row_id long, label string, x array<double>"


@pytest.fixture(scope="module")
def fx(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3)) * [1, 20, 0.1]
    x[200:300] = x[200]  # equal rows, equal margins
    label = rng.choice(["a", "b", "c"], 900, p=[0.6, 0.3, 0.1])
    x[:, 0] += label == "b"
    rows = [(int(i), str(c), [float(v) for v in r]) for i, c, r in zip(rng.permutation(900) * 7, label, x)]
    rows += [(10**6, "a", None), (10**6 + 1, "b", [None, 1.0, float("nan")]), (10**6 + 2, None, [0.0] * 3), (10**6 + 3, "d", [0.5, 0.5, 0.5])]
    return spark.createDataFrame(rows, KIND).repartition(5).cache()


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 64)


def fitted(fx):
    fx_y, classes, counts, spec, pairs, nf = plan.prepare(fx, 8)
    return fit_histogram(fx_y.where("row_id % 3 = 0"), spec, classes, pairs, nf), fx_y, spec, nf


def test_chunks_give_back_their_rows(fx, small):
    model, fx_y, spec, nf = fitted(fx)
    kept = chunks.pack(fx_y, nf, spec)
    plain = lambda df: sorted((r.row_id, r.y, *(None if v is None or np.isnan(v) else v for v in r.x or [None] * nf)) for r in df.select("row_id", "y", "x").collect())
    key = lambda rows: [str(r) for r in rows]
    assert key(plain(chunks.unpack(kept, nf))) == key(plain(fx_y))
    some = np.array(sorted(r.row_id for r in fx_y.where("row_id % 4 = 1").collect()), np.int64)
    assert key(plain(chunks.rows_of(kept, some, nf))) == key(plain(fx_y.where("row_id % 4 = 1")))
    assert chunks.rows_of(kept, np.zeros(0, np.int64), nf).count() == 0
    assert all(r.first <= r.last and r.n <= 900 for r in kept.collect())


@pytest.mark.parametrize("limit", [64 << 20, 400])
def test_failed_chunks_are_the_failed_rows(fx, small, limit):
    model, fx_y, spec, nf = fitted(fx)
    scored = score(model, fx_y, limit=limit)
    known = np.array([0, 7, 14, 21, 10**6], np.int64)
    failed = failed_chunks(score(model, chunks.pack(fx_y, nf, spec), limit=limit), known, nf, 4).cache()
    want = failed_by_margin(scored).where(~F.col("row_id").isin(known.tolist()))
    got = {(int(i), r.y): float(m) for r in failed.collect() for i, m in zip(np.frombuffer(r.ids, np.int64), np.frombuffer(r.margin))}
    assert len(got) > 100
    assert got == {(r.row_id, r.y): pytest.approx(r.margin, abs=2e-9) for r in want.collect()}
    about = failed.agg(F.sum("n_scored"), F.sum("right")).first()
    assert tuple(about) == (scored.count(), scored.where("pred = y").count())
    assert sorted(map(tuple, largest_margins(widest_margins(failed)).collect())) == sorted(map(tuple, largest_margins(want).collect()))


@pytest.mark.parametrize("prefix", [None, 5])
def test_leaders_without_skipped_rows(spark, small, prefix):
    rng = np.random.default_rng(8)
    rows = [(int(i), int(i % 3), v.tolist()) for i, v in zip(rng.permutation(600), rng.normal(size=(600, 3)) * [1, 6, 2])]
    rows.append((10**6, 5, [0.0] * 3))  # a class that is skipped as a whole
    df = spark.createDataFrame(rows, "row_id long, y int, x array<double>").repartition(4)
    skip = np.array([0, 1, 2, 50, 51, 10**6], np.int64)
    rest = df.where(~F.col("row_id").isin(skip.tolist()))
    kept = chunks.pack(df, 3).cache()
    assert diameters(kept, 3, skip=skip) == diameters(rest, 3)
    assert sorted(map(tuple, leaders_of_chunks(kept, 3, 0.2, prefix=prefix, skip=skip).collect())) == sorted(map(tuple, leaders(rest, 3, 0.2, prefix=prefix).collect()))


def test_rounds_equal_those_of_plain_rows(spark, fx, small, monkeypatch):
    run = lambda **more: (lambda m, ids, log: ([tuple(r) for r in log.orderBy("round").collect()], sorted(r.row_id for r in ids.collect())))(*plan.adaptive_fit(fx, n_bins=8, epochs=1, rounds=2, patience=2, **more))
    want = run()
    assert len(want[0]) > 1 and want[0][0][3] > 0
    assert run(unique=True) == want
    monkeypatch.setattr(plan, "KNOWN_IDS", 10)  # the first round with chunks, the others with plain rows
    assert run(unique=True) == want


def test_epochs_read_the_training_rows_only(fx, monkeypatch):
    """No epoch joins the table, and no round moves the table's rows one by one."""
    seen = []
    own_train, own_score = plan.train, plan.score
    monkeypatch.setattr(plan, "train", lambda model, rows, **more: (seen.append(rows._jdf.queryExecution().optimizedPlan().toString()), own_train(model, rows, **more))[1])
    whole = []
    monkeypatch.setattr(plan, "score", lambda model, rows, **more: (whole.append((chunks.packed(rows), more.get("with_bins"))), own_score(model, rows, **more))[1])
    plan.adaptive_fit(fx, n_bins=8, epochs=1, rounds=1, unique=True)
    assert len(seen) == 1 and "InMemoryRelation" in seen[0].splitlines()[0]
    assert [p for p, epoch in whole if not epoch] == [True]
