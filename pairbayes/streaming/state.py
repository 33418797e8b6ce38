"""Running cell counts as stream state, and a model version a micro-batch (ST2).

Tasks count their rows' cells; the sums of those counts are a keyed aggregation whose state Spark keeps in its
state store, under the stream's checkpoint folder.  A micro-batch hands over the cells
that it changed with their *totals*, not what it added, and writes them in a folder of
its own number, overwriting it.  A batch that is run again, after a crash between its
write and its commit, finds the same state and writes the same totals; so no count is
lost or doubled, and every batch number is a model version that can be read at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbayes.operators.binning import bin_rows
from pairbayes.operators.likelihood import CELL_KEYS, HistogramModel
from pairbayes.operators.lookup import task_counts

STATE_KEYS = ["y", *CELL_KEYS]


def running_counts(fx_y: DataFrame, model: HistogramModel) -> DataFrame:
    """(y, pair_id, bi, bj, n) of a streaming (y, x) under the model's frozen bins and pairs."""
    binned = bin_rows(fx_y.where("y IS NOT NULL"), model.spec, keep=("y",))
    return task_counts(binned, model.pairs, model.n_features, model.B, model.n_classes).groupBy(*STATE_KEYS).agg(F.sum("n").alias("n"))


def running_counts_stream(fx_y: DataFrame, model: HistogramModel, sink: str, checkpoint: str):
    """Start the stream (available data, then stop); totals go to ``<sink>/version=<batch>``."""

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{sink}/version={batch_id}")

    counts = running_counts(fx_y, model)
    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_at(spark: SparkSession, sink: str, version: int | None = None) -> DataFrame:
    """(y, pair_id, bi, bj, n) after a version (the latest, if none is given): each cell's last total."""
    rows = spark.read.parquet(sink)
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    return rows.groupBy(*STATE_KEYS).agg(F.max_by("n", "version").alias("n"))


def versions(spark: SparkSession, sink: str) -> list[int]:
    """Versions that changed a cell, in order."""
    return [r["version"] for r in spark.read.parquet(sink).select("version").distinct().orderBy("version").collect()]


def model_at(spark: SparkSession, model: HistogramModel, sink: str, version: int | None = None) -> HistogramModel:
    """The model with the counts of a version; rows per class are those of its first pair."""
    counts = counts_at(spark, sink, version)
    totals = {r["y"]: r["n"] for r in counts.where("pair_id = 0").groupBy("y").agg(F.sum("n").alias("n")).collect()}
    return HistogramModel(model.spec, model.pairs, model.n_features, model.classes, tuple(int(totals.get(c, 0)) for c in range(model.n_classes)),
                          counts, None, model.w0, model.eps)
