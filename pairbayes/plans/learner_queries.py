"""Registered learner queries on the driver tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the DuckDB oracle in ``pairbayes.plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbayes.operators.binning import explode_cells, bin_rows, fit_bins
from pairbayes.operators.boost import failed_rows, merge_weights, weight_deltas
from pairbayes.operators.encode import class_list, encode_labels
from pairbayes.operators.features import feature_frame
from pairbayes.operators.likelihood import class_moments, fit_histogram, occupied_cells, probabilities
from pairbayes.operators.metrics import confusion, per_class_report, summary_report
from pairbayes.operators.posterior import gaussian_score, score
from pairbayes.plans.train import TrainLog, train
from pairbayes.session import table

# Query parameters (fixed per registered query).
EMB_DIMS = 64  # whole embedding vectors
EMB_BINS = 16
# Boosting and evaluation queries run on lineitem: its four measures do not
# determine the return flag, so the model makes real errors to boost (on the
# embeddings the unboosted model already fits every row).
BOOST_BINS = 32
LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_BINS = 32
ROUND = 6


def _emb(spark: SparkSession, sf_dir: str, dims: int = EMB_DIMS):
    fx = feature_frame(table(spark, sf_dir, "embeddings"), "vec_id", "label", array_col="embedding", n_dims=dims)
    classes = class_list(fx)
    fx_y = encode_labels(fx, classes)
    return fx_y, classes


def _emb_model(spark, sf_dir, dims=EMB_DIMS, n_bins=EMB_BINS):
    fx_y, classes = _emb(spark, sf_dir, dims)
    spec = fit_bins(fx_y, dims, n_bins)
    model = fit_histogram(fx_y, spec, classes, None, dims)
    return model, fx_y


def emb_bin_edges(spark, sf_dir) -> DataFrame:
    """B2/A3: per feature lo, width and hi of the equal bins, as a Spark plan
    (posexplode -> groupBy(feature) min/max -> padding arithmetic)."""
    from pairbayes.operators.binning import edges_frame

    fx_y, _ = _emb(spark, sf_dir)
    e = edges_frame(fx_y, EMB_BINS)
    return e.select("feature", F.round("lo", 9).alias("lo"), F.round("width", 9).alias("width"),
                    F.round("hi", 9).alias("hi"))


def emb_bin_assign(spark, sf_dir) -> DataFrame:
    """(row_id, feature, bin) for every row and feature."""
    fx_y, _ = _emb(spark, sf_dir)
    spec = fit_bins(fx_y, EMB_DIMS, EMB_BINS)
    b = bin_rows(fx_y, spec, keep=("row_id",))
    return b.select("row_id", F.posexplode("b").alias("feature", "bin")).select(
        "row_id", F.col("feature").cast("int").alias("feature"), F.col("bin").cast("int").alias("bin")
    )


def emb_cell_counts(spark, sf_dir) -> DataFrame:
    """A4/B1: 2-D histogram counts per (class, pair, cell), with the pair's features."""
    model, _ = _emb_model(spark, sf_dir)
    from pairbayes.operators.binning import pairs_table

    return model.counts.join(pairs_table(spark, EMB_DIMS), "pair_id").select(
        "y", "pair_id", "f1", "f2", "bi", "bj", F.col("n").cast("long").alias("n")
    )


def emb_likelihood(spark, sf_dir) -> DataFrame:
    """Smoothed cell probabilities of occupied cells."""
    model, _ = _emb_model(spark, sf_dir)
    return probabilities(model).select("y", "pair_id", "bi", "bj", F.round("p", 9).alias("p"))


def emb_overlap_cells(spark, sf_dir) -> DataFrame:
    """A5: cells occupied by at least two classes."""
    model, _ = _emb_model(spark, sf_dir)
    return occupied_cells(model).select("pair_id", "bi", "bj", F.col("n_classes").cast("long").alias("n_classes"))


def emb_posterior(spark, sf_dir) -> DataFrame:
    """B6 + W4: predicted class and confidence per row (no boosting)."""
    model, fx_y = _emb_model(spark, sf_dir)
    s = score(model, fx_y)
    return s.select(F.col("row_id"), F.col("y").alias("true_class"), F.col("pred").alias("pred_class"),
                    F.round("confidence", ROUND).alias("confidence"))


def emb_confusion(spark, sf_dir) -> DataFrame:
    """Confusion matrix of the unboosted histogram model, zero-filled."""
    model, fx_y = _emb_model(spark, sf_dir)
    s = score(model, fx_y)
    return confusion(s)


def _boost_fx(spark, sf_dir):
    """lineitem (row_id = position in key order, label = return flag,
    x = the four measures), every row."""
    from pairbayes.operators.sampling import global_index

    li = table(spark, sf_dir, "lineitem").select(*LI_KEYS, F.col("l_returnflag").alias("label"), *[F.col(c).cast("double").alias(c) for c in LI_FEATURES])
    # numbers take less room than an array of them; the keys are needed for the order only
    return global_index(li, LI_KEYS, "row_id", keep=["label", *LI_FEATURES]).select("row_id", "label", F.array(*LI_FEATURES).alias("x"))


def _boost_model(spark, sf_dir):
    fx = _boost_fx(spark, sf_dir)
    classes = class_list(fx)
    fx_y = encode_labels(fx, classes)
    spec = fit_bins(fx_y, len(LI_FEATURES), BOOST_BINS)
    return fit_histogram(fx_y, spec, classes, None, len(LI_FEATURES)), fx_y


def _emb_trained(spark, sf_dir, epochs=2):
    model, fx_y = _boost_model(spark, sf_dir)
    model = train(model, fx_y, epochs=epochs, patience=5, unique=True)
    return model, fx_y


def li_boost_weights(spark, sf_dir) -> DataFrame:
    """Sparse weights after two boosting epochs."""
    model, _ = _emb_trained(spark, sf_dir, 2)
    return model.weights.select("y", "pair_id", "bi", "bj", F.round("w", 9).alias("w"))


def li_boosted_predictions(spark, sf_dir) -> DataFrame:
    """B11 (fixed 2 epochs) then B13: predictions with the boosted weights."""
    model, fx_y = _emb_trained(spark, sf_dir, 2)
    s = score(model, fx_y, unique=True)
    return s.select("row_id", F.col("y").alias("true_class"), F.col("pred").alias("pred_class"),
                    F.round("confidence", ROUND).alias("confidence"))


def emb_class_report(spark, sf_dir) -> DataFrame:
    """Per-class precision/recall/F1 of the unboosted model."""
    model, fx_y = _emb_model(spark, sf_dir)
    r = per_class_report(score(model, fx_y))
    return r.select("cls", "support", "tp", "predicted", *[F.round(c, ROUND).alias(c) for c in ("precision", "recall", "f1")])


def emb_summary_report(spark, sf_dir) -> DataFrame:
    """A11 summary: accuracy, macro/weighted averages, mean class accuracy."""
    model, fx_y = _emb_model(spark, sf_dir)
    r = summary_report(per_class_report(score(model, fx_y)))
    return r.select(*[F.round(c, ROUND).alias(c) for c in r.columns])


def emb_class_moments(spark, sf_dir) -> DataFrame:
    """Per (class, pair) means and regularised covariance."""
    fx_y, _ = _emb(spark, sf_dir)
    m = class_moments(fx_y, None, EMB_DIMS)
    return m.select("y", "pair_id", F.col("n").cast("long").alias("n"),
                    *[F.round(c, ROUND).alias(c) for c in ("m1", "m2", "c11", "c12", "c22")])


def emb_gaussian_predictions(spark, sf_dir) -> DataFrame:
    """Gaussian pairwise posterior (no log-determinant), argmax."""
    fx_y, classes = _emb(spark, sf_dir)
    m = class_moments(fx_y, None, EMB_DIMS)
    s = gaussian_score(m, fx_y, classes, None, EMB_DIMS)
    return s.select("row_id", F.col("y").alias("true_class"), F.col("pred").alias("pred_class"),
                    F.round("confidence", ROUND).alias("confidence"))


def lineitem_confusion(spark, sf_dir) -> DataFrame:
    """Learner at table scale: 4 lineitem measures -> l_returnflag, B=32,
    two boosting epochs, confusion of the boosted model."""
    fx = feature_frame(table(spark, sf_dir, "lineitem"),
                       F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"),
                       "l_returnflag", cols=LI_FEATURES)
    classes = class_list(fx)
    fx_y = encode_labels(fx, classes)
    spec = fit_bins(fx_y, len(LI_FEATURES), LI_BINS)
    model = fit_histogram(fx_y, spec, classes, None, len(LI_FEATURES))
    s = score(model, fx_y)
    return confusion(s)


QUERIES = {
    "emb_bin_edges": emb_bin_edges,
    "emb_bin_assign": emb_bin_assign,
    "emb_cell_counts": emb_cell_counts,
    "emb_likelihood": emb_likelihood,
    "emb_overlap_cells": emb_overlap_cells,
    "emb_posterior": emb_posterior,
    "emb_confusion": emb_confusion,
    "li_boost_weights": li_boost_weights,
    "li_boosted_predictions": li_boosted_predictions,
    "emb_class_report": emb_class_report,
    "emb_summary_report": emb_summary_report,
    "emb_class_moments": emb_class_moments,
    "emb_gaussian_predictions": emb_gaussian_predictions,
}
