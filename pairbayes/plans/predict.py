"""Fit-and-evaluate (B12) and prediction on new rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbayes.operators.binning import class_profile, edges_from_minmax
from pairbayes.operators.encode import apply_codes, encode_labels
from pairbayes.operators.likelihood import HistogramModel, fit_histogram
from pairbayes.operators.posterior import score
from pairbayes.plans.train import TrainLog, train
from pairbayes.sources.model_store import load_model, save_model, stored_measure


def fit_predict(fx: DataFrame, n_features: int, n_bins: int = 128, epochs: int = 0, split_col: str = "split",
                log: TrainLog | None = None) -> tuple[HistogramModel, DataFrame]:
    """Classes, bins and counts from the 'train' rows only; boost on
    them; score every row, unlabelled ones and unknown labels too (``y`` null).
    ``fx``: (row_id, label, x, split)."""
    tr = fx.where(F.col(split_col) == "train")
    classes, counts, mins, maxs = class_profile(tr, n_features)
    spec = edges_from_minmax(mins, maxs, n_bins)
    tr_y = encode_labels(tr, classes).where(F.col("y").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_histogram(tr_y, spec, classes, None, n_features, class_counts=counts)
    if epochs > 0:
        model = train(model, tr_y, epochs=epochs, log=log)
    all_y = encode_labels(fx, classes)
    scored = score(model, all_y, keep=("row_id", "y", split_col))
    return model, scored


def fit_save(fx: DataFrame, n_features: int, base: str, n_bins: int = 128, epochs: int = 0, split_col: str = "split",
             by_class: bool = True, encoders: DataFrame | None = None, feature_names: list[str] | None = None,
             options: dict | None = None) -> tuple[HistogramModel, DataFrame, dict]:
    """B12 with save-if-better: fit, score every row, and store the model (with its category codes and
    column names) only if its measure beats the stored one's.

    The measure is the mean accuracy of the classes over all labelled rows, or the overall accuracy
    (``by_class=False``).  Returns (model, scored, {measure, before, saved})."""
    spark = fx.sparkSession
    model, scored = fit_predict(fx, n_features, n_bins, epochs, split_col)
    ok = F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0)
    per = scored.where(F.col("y").isNotNull()).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("c"))
    measure = F.avg(F.col("c") / F.col("n")) if by_class else F.sum("c") / F.sum("n")
    got = per.agg(measure.alias("m")).first()["m"] or 0.0
    before = stored_measure(spark, base)
    saved = before is None or got > before
    if saved:
        save_model(model, base, feature_names=feature_names, encoders=encoders, options=(options or {}) | {"measure": float(got)})
    return model, scored, {"measure": float(got), "before": before, "saved": saved}


def coded_features(df: DataFrame, names: list[str], encoders: DataFrame | None, integer_columns: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``x``: its columns ``names`` as doubles, category columns by their stored codes (an unseen
    value takes the column's mean code)."""
    coded = [] if encoders is None else sorted(r["column_name"] for r in encoders.select("column_name").distinct().collect())
    raw = df.withColumns({f"__raw_{c}": F.col(c) for c in coded})
    out = apply_codes(raw, encoders, coded, integer_columns) if coded else raw
    out = out.withColumn("x", F.array(*[F.col(c).cast("double") for c in names]))
    return out.withColumns({c: F.col(f"__raw_{c}") for c in coded}).drop(*[f"__raw_{c}" for c in coded])


def predict_stored(spark: SparkSession, base: str, df: DataFrame, row_id: str) -> DataFrame:
    """S16 + B13: predictions of the stored model for raw rows, coded by the encoders stored with it."""
    model, manifest, encoders = load_model(spark, base)
    fx = coded_features(df, manifest["feature_names"], encoders).select(F.col(row_id).alias("row_id"), "x")
    return predict_new(model, fx)


def predict_new(model: HistogramModel, fx: DataFrame, keep=("row_id",)) -> DataFrame:
    """Score rows with a frozen model and decode the class label;
    ``prob_<class>`` columns for each class (C is small)."""
    s = score(model, fx.withColumn("y", F.lit(None).cast("int")) if "y" not in fx.columns else fx, keep=tuple(keep) + ("y",))
    names = F.lit(list(model.classes))
    out = s.withColumn("predicted_class", names[F.col("pred")])
    for i, c in enumerate(model.classes):
        out = out.withColumn(f"prob_{c}", F.col("posterior")[i])
    return out.withColumnRenamed("confidence", "prediction_confidence")


def evaluation_by_split(scored: DataFrame, split_col: str = "split") -> DataFrame:
    """Accuracy, mean confidence (A29) and mean class accuracy per split,
    from ONE aggregation of the scores (per split and class), so the
    scoring plan runs once.  Rows without a known label are left out of it."""
    from pairbayes.operators.metrics import _small

    ok = F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0)
    cnt = _small(scored.where(F.col("y").isNotNull()).groupBy(split_col, "y").agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("c"),
                                                    F.sum("confidence").alias("sc")))
    return cnt.groupBy(split_col).agg(
        F.sum("n").alias("n"), (F.sum("c") / F.sum("n")).alias("accuracy"),
        (F.sum("sc") / F.sum("n")).alias("mean_confidence"), F.avg(F.col("c") / F.col("n")).alias("mean_class_accuracy"))
