"""Matching, active selection, determinism, model store, config, entry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01


def test_nearest_point_matches_brute_force(spark):
    from pairbayes.operators.match import nearest_point

    rng = np.random.default_rng(1)
    pts = [(f"p{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 20, size=(60, 2)))]
    pts += [("a_tie", 5.0, 5.0), ("b_tie", 5.0, 5.0)]  # identical location: smaller name wins
    qs = [(f"q{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 25, size=(40, 2)))]
    qs.append(("qtie", 5.0, 5.0))
    P = spark.createDataFrame(pts, "pid string, x double, y double")
    Q = spark.createDataFrame(qs, "qid string, x double, y double")
    got = {r.qid: (r.pid, r.distance) for r in nearest_point(Q, P, "qid", "x", "y", "pid", "x", "y", cell=1.5).collect()}
    for qid, qx, qy in qs:
        best = min(pts, key=lambda p: ((p[1] - qx) ** 2 + (p[2] - qy) ** 2, p[0]))
        assert got[qid][0] == best[0]
        assert got[qid][1] == pytest.approx(math.hypot(best[1] - qx, best[2] - qy))


def test_tolerance_join_and_vote(spark):
    from pairbayes.operators.match import majority_vote, tolerance_join_cols

    base = [1.0, 2.0, 3.0]
    src = spark.createDataFrame([("s1", 1, base)], "s_name string, label int, sv array<double>")
    preds = spark.createDataFrame([
        (0, 1, [1.0, 2.0, 3.0 + 1e-7], 1),   # within tolerance
        (1, 1, [1.0, 2.0, 3.0], 0),          # exact
        (2, 1, [1.0, 2.5, 3.0], 1),          # outside
        (3, 2, [1.0, 2.0, 3.0], 1),          # other label
    ], "row_id long, label int, pv array<double>, predicted_class int")
    m = tolerance_join_cols(src, preds, "label", "sv", "pv")
    assert sorted(r.row_id for r in m.collect()) == [0, 1]
    v = majority_vote(m, "s_name", "predicted_class", "row_id").collect()[0]
    # one vote each: tie -> the class met first (row 0 -> class 1)
    assert (v.winner, v.total, v.winner_votes) == (1, 2, 1)


@pytest.mark.parametrize("parts", [1, 5])
def test_grid_leaders_and_selection(spark, parts):
    from pairbayes.operators.active import grid_leaders, select_samples

    rng = np.random.default_rng(3)
    x = rng.random((300, 2)) * [5.0, 0.0]
    rows = [(i, i % 3, [float(v) for v in x[i]]) for i in range(300)] + [(300, 0, [None, 1.0])]
    df = spark.createDataFrame(rows, "row_id long, y int, x array<double>").repartition(parts)
    got = {tuple(r) for r in grid_leaders(df, 2, 0.1).collect()}
    want = set()
    for y in range(3):
        own = [(i, v) for i, c, v in rows if c == y]
        lo, hi = [min(v[k] for _, v in own if v[k] is not None) for k in (0, 1)], [max(v[k] for _, v in own if v[k] is not None) for k in (0, 1)]
        cells = {}
        for i, v in own:
            cell = tuple(-1 if v[k] is None else math.floor((v[k] - lo[k]) / (hi[k] - lo[k]) / 0.1) if hi[k] > lo[k] else 0 for k in (0, 1))
            cells[cell] = min(cells.get(cell, i), i)
        want |= {(i, y) for i in cells.values()}
    assert got == want
    scored = df.select("row_id", "y", F.lit(9).alias("pred"), F.lit(0.9).alias("confidence"), F.array(*[F.lit(0.0)] * 3).alias("posterior"))
    sel = select_samples(scored, df, scored.groupBy("y").agg(F.count(F.lit(1)).alias("n")), 2).collect()
    assert {0, 1, 2, 3, 4, 5} <= {r["row_id"] for r in sel}  # equal margins: the two lowest ids of a class


def test_pair_blocks_score_alike(spark):
    from pairbayes.operators.binning import fit_bins
    from pairbayes.operators.boost import failed_rows, weight_deltas
    from pairbayes.operators.likelihood import fit_histogram, pair_blocks
    from pairbayes.operators.posterior import score

    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(v) for v in rng.normal(i % 2, 1, 6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, y int, x array<double>")
    model = fit_histogram(df, fit_bins(df, 6, 8), ["a", "b"], None, 6)
    assert pair_blocks(model) == [(0, 15)]
    assert len(pair_blocks(model, 1)) == 15 and len(pair_blocks(model, 20_000)) > 1
    one = {r["row_id"]: (r["pred"], round(r["confidence"], 9)) for r in score(model, df).collect()}
    assert one == {r["row_id"]: (r["pred"], round(r["confidence"], 9)) for r in score(model, df, limit=1).collect()}
    failed = failed_rows(score(model, df, with_bins=True), 0.1)
    dw = [{(r["y"], r["pair_id"], r["bi"], r["bj"]): round(r["dw"], 9) for r in weight_deltas(model, failed, limit=n).collect()} for n in (1, 1 << 26)]
    assert dw[0] == dw[1] and dw[0]


def test_tolerance_without_normalising(spark):
    from pairbayes.operators.match import tolerance_join_cols

    rng = np.random.default_rng(2)
    p = np.r_[rng.normal(0, 5000, 40), [5000.0, -5000.0, 0.0, 1e-6, 1e9]]
    s = np.r_[p * (1 + rng.uniform(-3e-5, 3e-5, len(p))), [5000.045, 0.0, -0.00001]]
    a = spark.createDataFrame([(i, 0, [float(v)]) for i, v in enumerate(s)], "i int, label int, sv array<double>")
    b = spark.createDataFrame([(j, 0, [float(v)]) for j, v in enumerate(p)], "j int, label int, pv array<double>")
    got = {(r["i"], r["j"]) for r in tolerance_join_cols(a, b, "label", "sv", "pv", normalize=False).collect()}
    want = {(i, j) for i, u in enumerate(s) for j, v in enumerate(p) if abs(u - v) <= 1e-5 + 1e-5 * abs(v)}
    assert got == want and (len(p), 40) in got


def test_nearest_keeps_every_query(spark):
    from pairbayes.operators.match import nearest_point

    rng = np.random.default_rng(8)
    pts = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(np.r_[rng.normal(0, 1e-3, (60, 2)), rng.normal(0, 100, (5, 2))])] + [("none", None, 1.0)]
    qs = [(f"q{i}", float(x), float(y)) for i, (x, y) in enumerate(np.r_[rng.normal(0, 1, (20, 2)), [[1e7, -1e7]]])] + [("lost", None, None)]
    q = spark.createDataFrame(qs, "q string, x double, y double")
    p = spark.createDataFrame(pts, "p string, x double, y double")
    got = {r["q"]: r["p"] for r in nearest_point(q, p, "q", "x", "y", "p", "x", "y").collect()}
    want = {n: min(((x - u) ** 2 + (y - v) ** 2, m) for m, u, v in pts[:-1])[1] for n, x, y in qs[:-1]} | {"lost": None}
    assert got == want
    assert {r["p"] for r in nearest_point(q, p.limit(0), "q", "x", "y", "p", "x", "y").collect()} == {None}


def test_zero_images_and_vectors(spark):
    from pairbayes.operators import pixels
    from pairbayes.operators.embed import contrastive_scores

    pix = spark.createDataFrame([(0, y, x, 0.0) for y in range(5) for x in range(5)] + [(1, 0, 0, 0.0)], "image_id int, y int, x int, v double")
    for f in (pixels.shape_stats, pixels.asymmetry, pixels.seeing, pixels.tail_snr, pixels.bright_heterogeneity, pixels.laplacian_stats, pixels.sobel_sharpness, pixels.cosmic_rays, pixels.local_texture, pixels.image_quality, pixels.glcm):
        rows = f(pix).collect()
        assert len(rows) == (1 if f is pixels.glcm else 2)
    assert all(r["fwhm"] == r["concentration"] == 0.0 for r in pixels.shape_stats(pix).collect())
    v = spark.createDataFrame([(i, 0, [0.0, 0.0] if i == 0 else [1.0, float(i)]) for i in range(4)], "row_id long, y int, x array<double>")
    assert contrastive_scores(v).count() == 4


def test_borders_of_a_small_image(spark):
    from pairbayes.operators import pixels

    img = np.random.default_rng(1).random((5, 6))
    pix = spark.createDataFrame([(0, y, x, float(img[y, x])) for y in range(5) for x in range(6)], "image_id int, y int, x int, v double")
    g = (img * 255).astype(np.uint8).astype(float)
    m = np.pad(g, 1, mode="reflect")  # the pixel on the other side of the border pixel
    lap = m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:] - 4 * g
    r = pixels.laplacian_stats(pix).first()
    assert r["laplacian_variance"] == pytest.approx(lap.var()) and r["focus_score"] == pytest.approx(min(1, lap.var() / 500))
    e = np.pad(img, 1, mode="symmetric")  # the border pixel repeated
    col = e[:-2] + 2 * e[1:-1] + e[2:]
    row = e[:, :-2] + 2 * e[:, 1:-1] + e[:, 2:]
    mag = np.hypot(row[2:] - row[:-2], col[:, 2:] - col[:, :-2])
    assert pixels.sobel_sharpness(pix).first()["sharpness"] == pytest.approx(mag.mean())
    lo, hi = np.percentile(img, [10, 90])
    s = pixels.tail_snr(pix).first()
    noise = img[img < lo].std() + 1e-8
    assert s["snr"] == pytest.approx(img[img > hi].mean() / noise)
    assert s["cnr"] == pytest.approx((np.percentile(img, 95) - np.percentile(img, 5)) / noise)
    a = np.arcsinh(img - np.median(img))
    n = {(r["y"], r["x"]): r["norm"] for r in pixels.normalise_image(pix, "asinh").collect()}
    assert n[2, 3] == pytest.approx((a[2, 3] - a.min()) / (a.max() - a.min() + 1e-8))


def test_overlap_flag_and_statistics_are_saved(spark, tmp_path):
    from dataclasses import replace

    from pairbayes.operators.binning import fit_bins
    from pairbayes.operators.likelihood import fit_histogram
    from pairbayes.operators.posterior import score
    from pairbayes.sources.model_store import load_model, save_model

    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [float(v) for v in rng.normal(i % 2, 1, 3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, y int, x array<double>")
    model = replace(fit_histogram(df, fit_bins(df, 3, 6), ["a", "b"], None, 3), overlap_mask=True)
    save_model(replace(model, overlap_mask=False), str(tmp_path / "m"))
    save_model(model, str(tmp_path / "m"), feature_names=["u", "v", "w"], stats={"u": (1.0, 2.0)}, options={"epochs": 3})
    loaded, manifest, _ = load_model(spark, str(tmp_path / "m"))
    assert loaded.overlap_mask and manifest["stats"] == {"u": [1.0, 2.0]} and manifest["options"] == {"epochs": 3}
    key = lambda m: {r["row_id"]: (r["pred"], round(r["confidence"], 9)) for r in score(m, df).collect()}
    assert key(loaded) == key(model)


def test_unlabelled_rows_are_scored(spark):
    from pairbayes.plans.predict import evaluation_by_split, fit_predict

    rows = [(i, "ab"[i % 2] if i < 40 else [None, "new"][i % 2], [float(i % 2), float(i)], "train" if i < 30 else "test") for i in range(44)]
    df = spark.createDataFrame(rows, "row_id long, label string, x array<double>, split string")
    _, scored = fit_predict(df, 2, n_bins=4, epochs=1)
    assert scored.count() == 44 and scored.where("y is null and pred is not null").count() == 4
    assert {r["split"]: r["n"] for r in evaluation_by_split(scored).collect()} == {"train": 30, "test": 10}


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_determinism_under_partitioning(spark, parts):
    from pairbayes.plans.learner_queries import emb_posterior

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        a = sorted((r.row_id, r.pred_class, r.confidence) for r in emb_posterior(spark, SF001).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    b = sorted((r.row_id, r.pred_class, r.confidence) for r in emb_posterior(spark, SF001).collect())
    assert a == b


def test_model_roundtrip_same_predictions(spark):
    from pairbayes.operators.posterior import score
    from pairbayes.plans.learner_queries import _emb_trained
    from pairbayes.sources.model_store import load_model, save_model, scratch_path

    m, fx = _emb_trained(spark, SF001, 1)
    base = scratch_path(spark, "t-model")
    save_model(m, base)
    m2, manifest, _ = load_model(spark, base)
    assert manifest["format_version"] >= 2
    a = sorted((r.row_id, r.pred) for r in score(m, fx).collect())
    b = sorted((r.row_id, r.pred) for r in score(m2, fx).collect())
    assert a == b


def test_stream_equals_batch(spark):
    from pairbayes.plans.io_queries import emb_stream_scores
    from pairbayes.plans.learner_queries import emb_posterior

    a = sorted(tuple(r) for r in emb_stream_scores(spark, SF001).collect())
    b = sorted(tuple(r) for r in emb_posterior(spark, SF001).select("row_id", "true_class", "pred_class", "confidence").collect())
    assert a == b


def test_config_comments_and_merge():
    from pairbayes.config import LearnerConfig, clean_config, load_config

    text = """{
      // a comment
      "file_path": "data/x.csv", /* block */
      "_comment": "ignored",
      "likelihood_config": {"bin_sizes": [21]},
      "bin_sizes": [64],
    }"""
    cfg = load_config(text)
    assert cfg["likelihood_config"] == {"bin_sizes": [21]}  # replaced whole, not deep-merged
    assert "bin_sizes" not in clean_config(cfg)
    assert LearnerConfig.from_dict(cfg).n_bins == 21


def test_unseen_category_gets_mean_code(spark):
    from pairbayes.operators.encode import apply_codes, first_appearance_codes

    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "c")], "id long, cat string")
    codes = first_appearance_codes(train, ["cat"], "id")
    got = {r.value: r.code for r in codes.collect()}
    assert got == {"b": 0, "a": 1, "c": 2}
    new = spark.createDataFrame([(9, "a"), (10, "zzz")], "id long, cat string")
    enc = {r.id: r.cat for r in apply_codes(new, codes, ["cat"]).collect()}
    assert enc == {9: 1.0, 10: 1.0}


def test_spectrum_parse(spark):
    from pairbayes.sources.spectra import parse_spectrum

    df = spark.createDataFrame([("[9 1 2\n 3]",), ("[9 1 x 3]",), ("[9 1 2]",)], "t string")
    r = [row.p for row in df.select(parse_spectrum(F.col("t"), True, 3).alias("p")).collect()]
    assert r == [[1.0, 2.0, 3.0], None, None]


def test_coordinates_from_names(spark):
    from pairbayes.functions.columns import coord_from_name

    df = spark.createDataFrame([("gal_150.123_-2.456.jpg",), ("x_10_20.png",), ("nothing.jpg",)], "n string")
    ra, dec = coord_from_name(F.col("n"))
    r = [(a, b) for a, b in df.select(ra, dec).collect()]
    assert r[0] == (150.12, -2.46) and r[1] == (10.0, 20.0) and r[2] == (None, None)


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["true_class", "pred_class", "n"]
    assert df.count() >= 0


def test_rank_within_group_matches_row_number_on_skewed_groups(spark):
    from pyspark.sql import Window

    from pairbayes.operators.sampling import rank_within_group

    rng = np.random.default_rng(4)
    # one hot group holding most rows, several small ones
    ys = [0] * 3000 + list(rng.integers(1, 6, size=600))
    vals = rng.integers(0, 50, size=len(ys))  # many ties in the order value
    df = spark.createDataFrame([(i, int(y), int(v)) for i, (y, v) in enumerate(zip(ys, vals))], "row_id long, y int, v int")
    got = rank_within_group(df, "y", [F.col("v").desc(), F.col("row_id")], "rk", partitions=16)
    w = Window.partitionBy("y").orderBy(F.col("v").desc(), F.col("row_id"))
    exp = df.withColumn("rk", F.row_number().over(w))
    a = sorted((r.row_id, r.rk) for r in got.select("row_id", "rk").collect())
    b = sorted((r.row_id, r.rk) for r in exp.select("row_id", "rk").collect())
    assert a == b
