"""Difference boosting of cell weights.

One epoch is full batch: failures are found under fixed weights and the
weights change only after the epoch, so the whole epoch is one DataFrame
plan: filter failed rows -> look up the model's p of their cells -> sums by
(true class, cell) in each task and over the tasks -> merge into the sparse
weight table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from functools import reduce

from pairbayes.operators.likelihood import BROADCAST_BYTES, CELL_KEYS, HistogramModel, materialize_table, pair_blocks
from pairbayes.operators.lookup import block_cells, changed_cells

# Fixed values of the update rule.
SIMILARITY_THRESHOLD = 0.25
MIN_LR = 1e-6


def failed_rows(scored: DataFrame, lr: float) -> DataFrame:
    """Rows whose argmax differs from the true class, with the adjustment
    lr * (1 - P_true / P_pred).  ``scored`` must carry ``b``."""
    pt = F.col("posterior")[F.col("y")]
    pp = F.col("posterior")[F.col("pred")]
    return scored.where(F.col("pred") != F.col("y")).select(
        "y", "pred", "b", (F.lit(lr) * (F.lit(1.0) - pt / pp)).alias("adj")
    )


def weight_deltas(model: HistogramModel, failed: DataFrame, threshold: float = SIMILARITY_THRESHOLD,
                  rule: str = "threshold", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``(y, pair_id, bi, bj, dw)``: sum of adjustments of failed rows of
    true class y over their cells where p[pred] < threshold.

    ``rule="bin_overlap"`` (B14) instead updates only cells the predicted
    class does not occupy."""
    # a class's cells hold more than one and a half times the probability of an empty one
    below = {"threshold": [threshold] * model.n_classes, "bin_overlap": [1.5 * p0 for p0 in model.p0()]}
    if rule not in below:
        raise ValueError(rule)
    table, _ = materialize_table(model)
    parts = [changed_cells(failed, block_cells(table, "p", block, model.pairs, model.n_features, model.B, model.p0(), limit), model.n_features, model.n_classes, below[rule])
             for block in pair_blocks(model, limit)]
    return reduce(DataFrame.unionByName, parts).groupBy("y", *CELL_KEYS).agg(F.sum("dw").alias("dw"))


def merge_weights(model: HistogramModel, deltas: DataFrame) -> DataFrame:
    """w = coalesce(w, w0) + coalesce(dw, 0) over the union of cells."""
    if model.weights is None:
        return deltas.select("y", *CELL_KEYS, (F.lit(model.w0) + F.col("dw")).alias("w"))
    m = model.weights.join(deltas, ["y", *CELL_KEYS], "full_outer")
    return m.select("y", *CELL_KEYS, (F.coalesce(F.col("w"), F.lit(model.w0)) + F.coalesce(F.col("dw"), F.lit(0.0))).alias("w"))


def clamp_gaussian_update(w: DataFrame, ratio_col: str = "ratio") -> DataFrame:
    """Ratio clamped to 0.1..10, update clamped to +-1, weight >= 0."""
    r = F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.col(ratio_col)))
    upd = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("lr") * (F.lit(1.0) - r)))
    return w.withColumn("w", F.greatest(F.lit(0.0), F.col("w") + upd))


def smooth_weights(model: HistogramModel, keep: float = 0.7) -> DataFrame:
    """B17 (re-aimed): w' = keep*w + (1-keep)*avg(w of the same cell in pairs
    that share a feature).  Replaces the reference's untrained graph layer by
    a neighbour average.

    A pair's neighbours are those of its two features without itself, so sums
    per feature and cell are enough: two rows a weight, whatever the number of
    neighbours.  Neighbours without an entry hold w0."""
    from pairbayes.operators.binning import pairs_frame, pairs_table

    if model.weights is None:
        return None
    spark = model.weights.sparkSession
    pairs = pairs_table(spark, model.n_features) if model.pairs is None else pairs_frame(spark, list(model.pairs))
    sides = pairs.select("pair_id", F.array_distinct(F.array("f1", "f2")).alias("fs"))
    long = sides.select("pair_id", F.explode("fs").alias("f"))
    deg = long.join(long.groupBy("f").agg(F.count(F.lit(1)).alias("n")), "f").groupBy("pair_id").agg(F.sum(F.col("n") - 1).alias("deg"))
    own = F.col("w") - F.lit(model.w0)
    each = model.weights.join(sides, "pair_id").select("y", *CELL_KEYS, "w", F.explode("fs").alias("f"))
    sums = each.groupBy("y", "f", "bi", "bj").agg(F.sum(own).alias("s"))
    near = each.join(sums, ["y", "f", "bi", "bj"]).groupBy("y", *CELL_KEYS, "w").agg(F.sum(F.col("s") - own).alias("s"))
    near = near.join(deg, "pair_id")
    avg = F.when(F.col("deg") > 0, F.col("s") / F.col("deg") + F.lit(model.w0)).otherwise(F.col("w"))
    return near.select("y", *CELL_KEYS, (F.lit(keep) * F.col("w") + F.lit(1 - keep) * avg).alias("w"))


def pair_adjacency(pairs: DataFrame) -> DataFrame:
    """Pairs that share a feature, ``(a, b)`` with a < b.  An equi-join
    on the shared feature (each feature side exploded), not a cross join."""
    long = pairs.select("pair_id", F.explode(F.array("f1", "f2")).alias("f"))
    l = long.alias("l")
    r = long.alias("r")
    return (
        l.join(r, (F.col("l.f") == F.col("r.f")) & (F.col("l.pair_id") < F.col("r.pair_id")))
        .select(F.col("l.pair_id").alias("a"), F.col("r.pair_id").alias("b"))
        .distinct()
    )
