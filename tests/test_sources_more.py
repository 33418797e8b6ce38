"""Folder catalogues, epoch snapshots, object names, stored models, stream state."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbayes.operators import prep
from pairbayes.sources import catalogue, sinks


def test_catalogue_of_a_folder(spark, tmp_path):
    for name in ("ring/a.PNG", "ring/deep/b.jpg", "edge/c.fits.gz", "edge/notes.txt", "top.jpeg", "ring/no_ending"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {(r["class"], r["filename"]) for r in catalogue.binary_catalogue(spark, str(tmp_path)).collect()}
    assert got == {("ring", "a.PNG"), ("ring", "b.jpg"), ("edge", "c.fits.gz"), ("unknown", "top.jpeg")}


def test_a_rerun_epoch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "epochs")
    split = spark.createDataFrame([(1, "train"), (2, "test")], "row_id long, split string")
    for epoch in (0, 1, 1, 0):
        sinks.append_epoch_snapshot(split, path, epoch)
    assert sorted((r["epoch"], r["row_id"]) for r in spark.read.parquet(path).collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_object_names(spark):
    df = spark.createDataFrame([(7.0, "M31", 0), (None, "M31", 1), (float("nan"), None, 2), (None, None, 12345)], "rec double, SDSS_Obj string, i long")
    names = [r["n"] for r in df.select(sinks.object_names(df, "sky", place=F.col("i")).alias("n"), "i").orderBy("i").collect()]
    assert names == ["sky_7", "sky_M31", "sky_obj_0002", "sky_obj_12345"]
    assert df.select(sinks.object_names(df.drop("rec"), "sky").alias("n")).first()["n"] == "sky_M31"


def test_pair_cardinality(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 4.0]), (0, [None, 2.0, 3.0]), (1, [None, None, 1.0])], "g int, x array<double>")
    got = {r["g"]: r["cardinality"] for r in prep.pair_cardinality(df, "g", 3).collect()}
    assert got == {0: 1 + 2 + 2, 1: 0}


@pytest.fixture(scope="module")
def coloured(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        y = i % 2
        rows.append((i, "ab"[y], ["red", "blue"][y if rng.random() < 0.9 else 1 - y], float(rng.normal(y, 1)), "train" if i % 3 else "test"))
    return spark.createDataFrame(rows, "row_id long, label string, colour string, size double, split string")


def test_save_if_better_and_stored_codes(spark, coloured, tmp_path):
    from pairbayes.operators.encode import first_appearance_codes
    from pairbayes.plans.predict import coded_features, fit_save, predict_stored
    from pairbayes.sources.model_store import load_model, stored_measure

    base = str(tmp_path / "model")
    assert stored_measure(spark, base) is None
    codes = first_appearance_codes(coloured.where("split = 'train'"), ["colour"], "row_id")
    fx = coded_features(coloured, ["size", "colour"], codes)
    assert [r["colour"] for r in fx.orderBy("row_id").limit(3).collect()] == [r["colour"] for r in coloured.orderBy("row_id").limit(3).collect()]
    weak = fx.withColumn("x", F.array(F.lit(0.0), F.lit(0.0)))
    runs = [fit_save(f, 2, base, 8, encoders=codes, feature_names=["size", "colour"])[2] for f in (weak, fx, weak, fx)]
    assert [r["saved"] for r in runs] == [True, True, False, False]
    assert stored_measure(spark, base) == runs[1]["measure"] > runs[0]["measure"]
    assert load_model(spark, base)[2].count() == 2
    new = coloured.select("row_id", F.when(F.col("row_id") < 5, "green").otherwise(F.col("colour")).alias("colour"), "size", F.lit("x").alias("extra"))
    got = {r["row_id"]: r["predicted_class"] for r in predict_stored(spark, base, new, "row_id").collect()}
    right = {r["row_id"]: r["label"] for r in coloured.collect()}
    assert len(got) == 300 and np.mean([got[i] == right[i] for i in range(5, 300)]) > 0.8


def test_stream_state_survives_a_restart(spark, coloured, tmp_path):
    from pairbayes.operators.binning import fit_bins
    from pairbayes.operators.encode import encode_labels
    from pairbayes.operators.likelihood import fit_histogram
    from pairbayes.operators.posterior import score
    from pairbayes.streaming import state

    fx = encode_labels(coloured.select("row_id", "label", F.array("size", (F.col("row_id") % 7).cast("double")).alias("x")), ["a", "b"])
    model = fit_histogram(fx, fit_bins(fx, 2, 8), ["a", "b"], None, 2)
    files, sink, check = (str(tmp_path / n) for n in ("files", "sink", "check"))

    def add(lo, hi):
        fx.where(f"row_id >= {lo} AND row_id < {hi}").select("y", "x").coalesce(1).write.mode("append").parquet(files)

    def run():
        stream = spark.readStream.schema("y int, x array<double>").option("maxFilesPerTrigger", 1).parquet(files)
        state.running_counts_stream(stream, model, sink, check).awaitTermination()

    plain = lambda rows: {(r.y, r.pair_id, r.bi, r.bj, r.n) for r in rows.collect()}
    add(0, 100)
    run()
    first = plain(state.counts_at(spark, sink))
    assert sum(t[-1] for t in first) == 100
    add(100, 200)
    run()  # a new query on the same checkpoint folder
    assert sum(t[-1] for t in plain(state.counts_at(spark, sink))) == 200
    # killed after its write and before its commit: the batch runs again
    last = max(state.versions(spark, sink))
    (tmp_path / "check" / "commits" / str(last)).unlink()
    (tmp_path / "check" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    add(200, 300)
    run()
    assert plain(state.counts_at(spark, sink)) == plain(model.counts)
    assert plain(state.counts_at(spark, sink, 0)) == first
    served = state.model_at(spark, model, sink)
    assert served.class_counts == model.class_counts
    assert plain(served.counts) == plain(model.counts)
    a = {r.row_id: (r.pred, round(r.confidence, 9)) for r in score(served, fx).collect()}
    assert a == {r.row_id: (r.pred, round(r.confidence, 9)) for r in score(model, fx).collect()}
    shutil.rmtree(sink)
