"""Epoch loop (B11), fit/evaluate (B12) and adaptive rounds.

The driver holds only scalars per epoch (error count, learning rate,
patience); every row-level step is a Spark job.  Weights are checkpointed
into the shared checkpoint folder each epoch so the plan does not grow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.operators.binning import class_profile, edges_from_minmax, feature_pairs
from pairbayes.operators.boost import MIN_LR, failed_rows, merge_weights, weight_deltas
from pairbayes.operators.chunks import first_rows, pack, rows_of, unpack
from pairbayes.operators.encode import encode_labels
from pairbayes.operators.likelihood import HistogramModel, fit_histogram
from pairbayes.operators.posterior import score
from pairbayes.session import cut_lineage

LEARNING_RATE = 0.1
IMPROVEMENT_MIN = 0.001
#: Training ids that adaptive rounds send to every task.
KNOWN_IDS = 1 << 21


@dataclass
class TrainLog:
    rows: list[dict] = field(default_factory=list)

    def to_frame(self, spark) -> DataFrame:
        schema = "epoch int, n_rows long, n_errors long, error_rate double, lr double, patience int, best_error double"
        return spark.createDataFrame([tuple(r[k] for k in ("epoch", "n_rows", "n_errors", "error_rate", "lr", "patience", "best_error")) for r in self.rows], schema)


def prepare(fx: DataFrame, n_bins: int = 128, max_combinations: int | None = None, persist: bool = True):
    """Label codes, class totals, bins and pairs for ``(row_id, label, x)``
    from ONE aggregation pass (``class_profile``).  The encoded frame is
    persisted (memory and disk) because every epoch re-reads it."""
    from pairbayes.operators.features import n_features_of

    nf = n_features_of(fx)
    classes, counts, mins, maxs = class_profile(fx, nf)
    spec = edges_from_minmax(mins, maxs, n_bins)
    fx_y = encode_labels(fx, classes).where(F.col("y").isNotNull())
    if persist:
        fx_y = fx_y.persist(StorageLevel.MEMORY_AND_DISK)
    pairs = None
    if max_combinations is not None and nf * (nf - 1) // 2 > max_combinations:
        pairs = feature_pairs(nf, max_combinations)
    return fx_y, classes, counts, spec, pairs, nf


def train(model: HistogramModel, train_fx: DataFrame, epochs: int = 10, patience: int = 5,
          lr: float = LEARNING_RATE, rule: str = "threshold", log: TrainLog | None = None,
          keys: tuple[str, ...] = ("row_id",), n_rows: int | None = None, unique: bool = False) -> HistogramModel:
    """Full-batch epochs.

    Per epoch: score under fixed weights -> count failures -> patience/learning
    rate bookkeeping -> (if failures) halve lr and add the boosted deltas.
    The learning rate goes back to ``lr`` whenever the error drops by more
    than 0.001 (so the first update uses lr/2)."""
    log = log if log is not None else TrainLog()
    # ``keys`` identify a row (a composite key avoids hashing ids together);
    # ``n_rows`` saves a counting pass when the caller knows it, ``unique`` a shuffle an epoch
    # when it knows that no row has the keys of another
    n_rows = train_fx.count() if n_rows is None else n_rows
    best_error = float("inf")
    patience_counter = 0
    cur_lr = lr
    for epoch in range(epochs):
        scored = score(model, train_fx, keep=tuple(keys) + ("y",), with_bins=True, unique=unique)
        failed = failed_rows(scored, 1.0).persist(StorageLevel.MEMORY_AND_DISK)
        n_err = failed.count()
        err = n_err / n_rows if n_rows else 0.0
        if err <= best_error:
            improvement = best_error - err
            best_error = err
            if improvement <= IMPROVEMENT_MIN:
                patience_counter += 1
            else:
                patience_counter = 0
                cur_lr = lr
        else:
            patience_counter += 1
        log.rows.append(dict(epoch=epoch, n_rows=n_rows, n_errors=n_err, error_rate=err, lr=cur_lr,
                             patience=patience_counter, best_error=best_error))
        if patience_counter >= patience or n_err == 0:
            failed.unpersist()
            break
        cur_lr = max(cur_lr / 2, MIN_LR)
        scaled = failed.withColumn("adj", F.col("adj") * F.lit(cur_lr))
        deltas = weight_deltas(model, scaled, rule=rule)
        new_w = cut_lineage(merge_weights(model, deltas))
        failed.unpersist()
        model = model.with_weights(new_w)
    model.lr = cur_lr
    return model


def fit(fx: DataFrame, n_bins: int = 128, epochs: int = 10, patience: int = 5,
        max_combinations: int | None = None, likelihood_rows: DataFrame | None = None,
        log: TrainLog | None = None):
    """Fit counts on ``likelihood_rows`` (default: the training rows) and boost."""
    fx_y, classes, counts, spec, pairs, nf = prepare(fx, n_bins, max_combinations)
    if likelihood_rows is None:
        model = fit_histogram(fx_y, spec, classes, pairs, nf, class_counts=counts)
    else:
        base = encode_labels(likelihood_rows, classes).where(F.col("y").isNotNull())
        model = fit_histogram(base, spec, classes, pairs, nf)
    if epochs > 0:
        model = train(model, fx_y, epochs=epochs, patience=patience, log=log)
    return model, fx_y


def adaptive_fit(fx: DataFrame, n_bins: int = 128, epochs: int = 5, rounds: int = 10, patience: int = 3,
                 min_gain: float = 1e-4, likelihood_from_all: bool = False, max_combinations: int | None = None, unique: bool = False):
    """Seed two rows per class -> fit -> boost -> score every row ->
    add selected failures of the not-yet-training rows -> repeat, until no
    row is added or ``patience`` rounds pass without an accuracy gain.

    Returns (model, training ids, round log).  The training-id table is
    checkpointed each round so the plan does not grow with the rounds.

    Where the caller knows ``row_id`` to be ``unique``, all rows are kept as chunks
    with their bins (``operators/chunks.py``): scoring, the selection and its walk read
    arrays, and only failed rows leave a scoring pass.  More training ids than
    ``KNOWN_IDS`` are not broadcast; the rounds go on with plain rows then."""
    from pairbayes.operators.active import failed_chunks, select_samples
    from pairbayes.operators.sampling import seed_rows

    fx_y, classes, counts, spec, pairs, nf = prepare(fx, n_bins, max_combinations, persist=not unique)
    spark = fx_y.sparkSession
    kept = None
    if unique:
        kept = pack(fx_y, nf, spec).persist(StorageLevel.DISK_ONLY)  # the heap is not needed for arrays that tasks read in turn
        fx_y = unpack(kept, nf)
        train_ids = cut_lineage(seed_rows(first_rows(kept, 2), 2).select("row_id"))
    else:
        train_ids = cut_lineage(seed_rows(fx_y.select("row_id", "y"), 2).select("row_id"))
    log = []
    best = -1.0
    stale = 0
    model = None
    n_train = train_ids.count()
    for rnd in range(rounds):
        known = np.sort(np.array(train_ids.toArrow().column(0).to_numpy(), np.int64)) if unique and n_train <= KNOWN_IDS else None
        # the epochs read the training rows, not the table
        train_df = (fx_y.join(train_ids, "row_id", "left_semi") if known is None else rows_of(kept, known, nf)).persist(StorageLevel.MEMORY_AND_DISK)
        base = fx_y if likelihood_from_all else train_df
        model = fit_histogram(base, spec, classes, pairs, nf, class_counts=counts if likelihood_from_all else None)
        model = train(model, train_df, epochs=epochs, patience=5, unique=unique)
        if known is None:
            scored = score(model, fx_y, unique=unique).drop("ll").persist(StorageLevel.MEMORY_AND_DISK)
            acc_row = scored.agg(F.avg(F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0)).alias("a"),
                                 F.count(F.lit(1)).alias("n")).collect()[0]
            acc = float(acc_row["a"])
            rest = scored.join(train_ids, "row_id", "left_anti")
            sizes = rest.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
        else:
            scored = rest = failed_chunks(score(model, kept), known, nf, len(classes)).persist(StorageLevel.DISK_ONLY)
            acc_row = scored.agg(F.sum("right").alias("right"), F.sum("n_scored").alias("n")).collect()[0]
            acc = acc_row["right"] / acc_row["n"]
            own = {r["y"]: r["n"] for r in train_df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
            sizes = spark.createDataFrame([(y, n - own.get(y, 0)) for y, n in enumerate(counts)], "y int, n long")
        new = select_samples(rest, fx_y, sizes, nf).select("row_id")
        new = cut_lineage(new)
        n_new = new.count()
        log.append((rnd, n_train, acc, n_new))
        if acc > best + min_gain:
            best = acc
            stale = 0
        else:
            stale += 1
        scored.unpersist()
        train_df.unpersist()
        if n_new == 0 or stale >= patience:
            break
        train_ids = cut_lineage(train_ids.unionByName(new).distinct())
        n_train = train_ids.count()
    if kept is not None:
        kept.unpersist()
    log_df = spark.createDataFrame(log, "round int, n_train long, accuracy double, n_added long")
    return model, train_ids, log_df
