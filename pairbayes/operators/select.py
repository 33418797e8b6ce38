"""Feature selection (B21), distribution summaries (B25), method comparison
(B19) and small checks (P26, P27)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.operators.embed import class_separation, feature_correlation, label_correlation
from pairbayes.operators.quantiles import wide_quantiles
from pairbayes.session import cut_lineage

# Fixed values of the selection rule.
UPPER_THRESHOLD = 0.85
LOWER_THRESHOLD = 0.01
MIN_FEATURES = 8


def feature_scores(fx_y: DataFrame, n_classes: int) -> DataFrame:
    """``(feature, score)``: signed correlation with the label, blended 0.7 / 0.3
    with the class separation where there are more than 10 classes."""
    s = label_correlation(fx_y).select("feature", F.coalesce("corr", F.lit(0.0)).alias("score"))
    if n_classes <= 10:
        return s
    sep = class_separation(fx_y).select("feature", "score_norm")
    return s.join(sep, "feature", "left").select("feature", (0.7 * F.col("score") + 0.3 * F.coalesce("score_norm", F.lit(0.0))).alias("score"))


def select_features(fx_y: DataFrame, n_classes: int) -> DataFrame:
    """``(feature, score)`` of the features that stay.

    Candidates score 0.85 or more; if fewer than 8 do, the best 8 are taken.  A
    candidate is blocked by one of smaller index, no smaller score and a
    correlation with it above 0.01, if that one stays.  Stated as tables: the
    candidates, and who may block whom.  In every round a candidate all of whose
    possible blockers are out stays, and one with a blocker that stays is out;
    the first undecided index is always decided, so rounds end."""
    scores = cut_lineage(feature_scores(fx_y, n_classes))
    best = scores.orderBy(F.col("score").desc(), "feature").limit(MIN_FEATURES)
    strong = scores.where(F.col("score") >= UPPER_THRESHOLD)
    cand = strong if strong.limit(MIN_FEATURES).count() == MIN_FEATURES else best
    cand = cut_lineage(cand)
    names = sorted(r["feature"] for r in cand.select("feature").collect())  # at most F
    pairs = list(itertools.combinations(names, 2))
    if not pairs:
        return cand
    a, b = cand.toDF("f1", "s1"), cand.toDF("f2", "s2")
    blocks = feature_correlation(fx_y, pairs).where(F.col("corr") > LOWER_THRESHOLD).join(a, "f1").join(b, "f2")
    blocks = cut_lineage(blocks.where("s2 <= s1").select(F.col("f1").alias("by"), F.col("f2").alias("feature")))
    state = cand.withColumn("stays", F.lit(None).cast("boolean"))
    while True:
        seen = blocks.join(state.select(F.col("feature").alias("by"), F.col("stays").alias("by_stays")), "by")
        seen = seen.groupBy("feature").agg(F.max(F.col("by_stays").cast("int")).alias("some_stays"), F.count(F.when(F.col("by_stays").isNull(), 1)).alias("open"))
        now = F.when(F.col("some_stays") == 1, False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = cut_lineage(state.join(seen, "feature", "left").select("feature", "score", now.alias("stays")))
        if state.where("stays is null").isEmpty():
            return state.where("stays").drop("stays")


def distribution_data(fx_y: DataFrame, features, ps=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Per class and feature the quantiles behind the distribution plots."""
    x = F.col("x")
    lf = fx_y.select("y", F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), x[i].alias("v")) for i in features])).alias("s"))
    lf = lf.select("y", F.col("s.feature").alias("feature"), F.col("s.v").alias("v"))
    rows = lf.groupBy("y", "feature").agg(F.count(F.lit(1)).alias("n"))
    return wide_quantiles(lf, ["y", "feature"], "v", ps, "q").join(rows, ["y", "feature"], "right")


def unknown_targets(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """Labels not among the known classes (empty = valid)."""
    return df.select(F.col(label).cast("string").alias("label")).distinct().join(
        classes.select(F.col(classes.columns[0]).cast("string").alias("label")), "label", "left_anti")


def require_features(df: DataFrame, required) -> DataFrame:
    """Raise when required columns are missing; reorder to training order."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required feature columns: {missing}")
    return df.select(*required, *[c for c in df.columns if c not in required])


def compare_methods(fx_y: DataFrame, model, epochs: int = 3, unique: bool = False) -> DataFrame:
    """Accuracy, time and epochs for each weight-update rule."""
    import time

    from pairbayes.operators.posterior import score
    from pairbayes.plans.train import TrainLog, train

    rows = []
    for rule in ("threshold", "bin_overlap"):
        t = time.time()
        log = TrainLog()
        m = train(model, fx_y, epochs=epochs, rule=rule, log=log, unique=unique)
        acc = score(m, fx_y, unique=unique).agg(F.avg(F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0))).collect()[0][0]
        rows.append((rule, float(acc), float(time.time() - t), len(log.rows)))
    return fx_y.sparkSession.createDataFrame(rows, "method string, accuracy double, seconds double, epochs int")
