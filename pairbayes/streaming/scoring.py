"""Streaming scoring (ST1) and additive count refresh (ST2).

Scoring needs a group-by on the row id after the cell join, so each
micro-batch is scored by the batch scorer inside ``foreachBatch`` with the
frozen model: stateless, so a replayed batch gives the same rows.  Writes go
to ``<sink>/batch_id=<id>`` with overwrite, which makes replays idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbayes.operators.likelihood import HistogramModel, fit_counts
from pairbayes.operators.posterior import score


def stream_source(spark: SparkSession, directory: str, file_glob: str, schema, max_files: int | None = None) -> DataFrame:
    """The files of ``directory`` that match ``file_glob``, each a parquet file or a folder of them.

    A pattern that names one entry is written with its last letter as a class: Spark takes a plain
    path for the base folder of the stream, which a single file cannot be."""
    if not any(c in file_glob for c in "*?[{"):
        file_glob = f"{file_glob[:-1]}[{file_glob[-1]}]"
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{directory.rstrip('/')}/{file_glob}")


def score_stream(stream: DataFrame, model: HistogramModel, to_features, sink: str, checkpoint: str):
    """ST1: ``to_features`` maps a micro-batch to (row_id, y, x)."""

    def batch(df: DataFrame, batch_id: int) -> None:
        s = score(model, to_features(df))
        out = s.select("row_id", F.col("y").alias("true_class"), F.col("pred").alias("pred_class"), "confidence", "posterior")
        out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_counts_stream(stream: DataFrame, model: HistogramModel, to_features, sink: str, checkpoint: str):
    """ST2: per micro-batch cell counts under the model's frozen bins and
    pairs; totals are the sum over batches (counts are additive)."""

    def batch(df: DataFrame, batch_id: int) -> None:
        c = fit_counts(to_features(df), model.spec, model.pairs, model.n_features, model.n_classes)
        c.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_counts(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).groupBy("y", "pair_id", "bi", "bj").agg(F.sum("n").alias("n"))


def vote_counts_stream(stream: DataFrame, group: str, vote: str, order: str, sink: str, checkpoint: str):
    """Additive vote counts from a stream: per micro-batch (group, vote, n,
    first order key), written idempotently by batch id.  Counts add and the
    first key is a min, so merging the batches gives the batch answer."""

    def batch(df: DataFrame, batch_id: int) -> None:
        c = df.groupBy(group, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
        c.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
