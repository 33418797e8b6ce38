"""Registered sink/source/model-store/streaming queries.

Each writes under a fresh folder in the shared checkpoint directory and
reads its own output back, so the check covers the round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.operators.encode import encode_labels
from pairbayes.operators.features import feature_frame
from pairbayes.operators.posterior import score
from pairbayes.plans.learner_queries import BOOST_BINS, EMB_DIMS, ROUND, _boost_model, _emb_model, _emb_trained
from pairbayes.plans.oracles import boost_base, emb_base, hist_base, score_ctes
from pairbayes.session import table
from pairbayes.sources import sinks
from pairbayes.sources.model_store import load_model, save_model, scratch_path
from pairbayes.streaming.scoring import merged_counts, refresh_counts_stream, score_stream, stream_source


def li_model_roundtrip(spark, sf) -> DataFrame:
    """Boosted model saved, loaded back, used to score: must equal the
    in-memory model's predictions."""
    model, fx_y = _emb_trained(spark, sf, 2)
    base = scratch_path(spark, "model")
    save_model(model, base)
    loaded, manifest, _ = load_model(spark, base)
    s = score(loaded, fx_y, unique=True)
    return s.select("row_id", F.col("y").alias("true_class"), F.col("pred").alias("pred_class"),
                    F.round("confidence", ROUND).alias("confidence"))


def li_prediction_sink(spark, sf) -> DataFrame:
    """S11 + S14: predictions written partitioned by split and correctness,
    read back; per partition counts."""
    from pairbayes.operators.sampling import train_test_split

    model, fx_y = _boost_model(spark, sf)
    s = score(model, fx_y, unique=True)
    s = train_test_split(s, "row_id", 0.2, 42).withColumn("correct", F.col("pred") == F.col("y"))
    path = scratch_path(spark, "pred")
    sinks.write_predictions(s.select("row_id", "y", "pred", "confidence", "split", "correct"), path)
    back = spark.read.parquet(path).withColumn("correct", F.col("correct").cast("boolean"))
    return back.groupBy("split", "correct").agg(F.count(F.lit(1)).alias("n"))


def emb_feature_sink(spark, sf) -> DataFrame:
    """S13 + S12: feature_i columns with target and file-style names,
    priority columns first, written and read back."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    e = e.withColumn("filename", F.concat(F.lit("vec_"), F.col("vec_id").cast("string"), F.lit(".npy"))).withColumn(
        "target", F.col("label").cast("string"))
    f = sinks.feature_columns(e, "e", 64, keep=("target", "filename"))
    f = sinks.deterministic_columns(f, ["filename", "target"], "filename")
    path = scratch_path(spark, "features")
    f.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return back.select("filename", "target", *[F.round(f"feature_{i}", ROUND).alias(f"feature_{i}") for i in range(64)])


def _emb_schema():
    return "vec_id long, embedding array<float>, label int"


def emb_stream_scores(spark, sf) -> DataFrame:
    """ST1: the embeddings file read as a stream and scored per micro-batch
    with a model saved to and loaded from the model store; equals batch
    scoring."""
    fitted, _ = _emb_model(spark, sf)
    base = scratch_path(spark, "stream-model")
    save_model(fitted, base)
    model, _, _ = load_model(spark, base)
    classes = list(model.classes)

    def to_features(df):
        fx = feature_frame(df, "vec_id", "label", array_col="embedding", n_dims=EMB_DIMS, balance=False)
        return encode_labels(fx, classes)

    src = stream_source(spark, sf, "embeddings.parquet", _emb_schema())
    sink = scratch_path(spark, "stream-scores")
    q = score_stream(src, model, to_features, sink, scratch_path(spark, "stream-ckpt"))
    q.awaitTermination()
    back = spark.read.parquet(sink)
    return back.select("row_id", "true_class", "pred_class", F.round("confidence", ROUND).alias("confidence"))


def emb_stream_counts(spark, sf) -> DataFrame:
    """ST2: cell counts refreshed from a stream (additive per micro-batch),
    merged; equals the batch histogram."""
    model, _ = _emb_model(spark, sf)
    classes = list(model.classes)

    def to_features(df):
        fx = feature_frame(df, "vec_id", "label", array_col="embedding", n_dims=EMB_DIMS, balance=False)
        return encode_labels(fx, classes)

    src = stream_source(spark, sf, "embeddings.parquet", _emb_schema())
    sink = scratch_path(spark, "stream-counts")
    q = refresh_counts_stream(src, model, to_features, sink, scratch_path(spark, "stream-ckpt"))
    q.awaitTermination()
    return merged_counts(spark, sink).select("y", "pair_id", "bi", "bj", F.col("n").cast("long").alias("n"))


def emb_stream_versions(spark, sf) -> DataFrame:
    """ST2: running counts of a stream of several files, a version a micro-batch; the last version
    equals the batch histogram."""
    from pairbayes.streaming.state import counts_at, running_counts_stream

    model, _ = _emb_model(spark, sf)
    folder = scratch_path(spark, "stream-files")
    table(spark, sf, "embeddings").repartition(3, "vec_id").write.parquet(folder)
    src = stream_source(spark, folder, "*.parquet", _emb_schema(), max_files=1)
    fx = feature_frame(src, "vec_id", "label", array_col="embedding", n_dims=EMB_DIMS, balance=False)
    sink = scratch_path(spark, "stream-versions")
    running_counts_stream(encode_labels(fx, list(model.classes)), model, sink, scratch_path(spark, "stream-ckpt")).awaitTermination()
    return counts_at(spark, sink)


ORDER_FEATURES = ["o_totalprice", "o_orderpriority"]
ORDER_BINS = 16


def _orders_saved(spark, sf, base: str) -> tuple:
    """Status of orders learnt from those before September 1999; codes of the priorities are stored with the model."""
    from pairbayes.operators.encode import first_appearance_codes
    from pairbayes.plans.predict import coded_features, fit_save

    o = table(spark, sf, "orders")
    early = F.col("o_orderdate") < F.lit("1999-09-01").cast("timestamp_ntz")
    codes = first_appearance_codes(o.where(early), ["o_orderpriority"], "o_orderkey")
    fx = coded_features(o, ORDER_FEATURES, codes).select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("label"), "x", F.when(early, "train").otherwise("test").alias("split"))
    return fit_save(fx, len(ORDER_FEATURES), base, ORDER_BINS, encoders=codes, feature_names=ORDER_FEATURES)


def orders_stored_model(spark, sf) -> DataFrame:
    """S16 + B12 + B13: the model and its category codes saved, read back, and applied to the raw orders."""
    from pairbayes.plans.predict import predict_stored

    base = scratch_path(spark, "orders-model")
    _orders_saved(spark, sf, base)
    p = predict_stored(spark, base, table(spark, sf, "orders"), "o_orderkey")
    return p.select("row_id", "predicted_class", F.round("prediction_confidence", ROUND).alias("confidence"))


def orders_save_if_better(spark, sf) -> DataFrame:
    """A second, equal fit is not stored again."""
    base = scratch_path(spark, "orders-model")
    runs = [_orders_saved(spark, sf, base)[2] for _ in range(2)]
    rows = [(i, round(r["measure"], ROUND), r["saved"]) for i, r in enumerate(runs)]
    return spark.createDataFrame(rows, "run int, measure double, saved boolean")


QUERIES = {
    "orders_stored_model": orders_stored_model,
    "orders_save_if_better": orders_save_if_better,
    "emb_stream_versions": emb_stream_versions,
    "li_model_roundtrip": li_model_roundtrip,
    "li_prediction_sink": li_prediction_sink,
    "emb_feature_sink": emb_feature_sink,
    "emb_stream_scores": emb_stream_scores,
    "emb_stream_counts": emb_stream_counts,
}


def oracles(learner: dict[str, str]) -> dict[str, str]:
    from pairbayes.operators.sampling import split_unit_sql

    early = "o_orderdate < TIMESTAMP '1999-09-01'"
    orders = (f"codes AS (SELECT o_orderpriority AS value, row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority) - 1 AS code FROM orders WHERE {early} "
              "AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority), "
              + hist_base("SELECT o_orderkey AS row_id, o_orderstatus AS label, [o_totalprice, coalesce(CAST(code AS DOUBLE), (SELECT avg(code) FROM codes))] AS e "
                          "FROM orders LEFT JOIN codes ON value = o_orderpriority", 2, ORDER_BINS, f"row_id IN (SELECT o_orderkey FROM orders WHERE {early})")
              + "," + score_ctes("s", None, ORDER_BINS))
    feats = ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), {ROUND}) AS feature_{i}" for i in range(64))
    return {
        "li_model_roundtrip": learner["li_boosted_predictions"],
        "li_prediction_sink": "WITH " + boost_base() + "," + score_ctes("s", None, BOOST_BINS) + f"""
SELECT CASE WHEN {split_unit_sql('row_id')} < 0.8e0 THEN 'train' ELSE 'test' END AS split, pred = ytrue AS correct, count(*) AS n
FROM pred_s GROUP BY 1, 2""",
        "emb_feature_sink": f"""SELECT 'vec_' || CAST(vec_id AS VARCHAR) || '.npy' AS filename, CAST(label AS VARCHAR) AS target, {feats} FROM embeddings""",
        "emb_stream_scores": learner["emb_posterior"],
        "orders_stored_model": f"WITH {orders} SELECT row_id, c.label AS predicted_class, round(pmax, {ROUND}) AS confidence FROM pred_s p JOIN cls c ON c.y = p.pred",
        "orders_save_if_better": f"""WITH {orders}, a AS (SELECT avg(acc) AS m FROM (SELECT avg(CASE WHEN pred = ytrue THEN 1.0e0 ELSE 0.0e0 END) AS acc FROM pred_s GROUP BY ytrue))
SELECT CAST(run AS INTEGER) AS run, round(m, {ROUND}) AS measure, run = 0 AS saved FROM a CROSS JOIN range(0, 2) t(run)""",
        "emb_stream_versions": "WITH " + emb_base() + " SELECT y, pair_id, bi, bj, n FROM counts",
        "emb_stream_counts": "WITH " + emb_base() + " SELECT y, pair_id, bi, bj, n FROM counts",
    }


def events_stream_vote(spark, sf) -> DataFrame:
    """Events read as a file stream with an explicit schema; additive vote
    counts per micro-batch (foreachBatch), merged, then each user's majority
    event type (ties -> the type met first): equals the batch vote."""
    from pyspark.sql import Window

    from pairbayes.streaming.scoring import vote_counts_stream

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    src = stream_source(spark, sf, "events.parquet", schema)
    sink = scratch_path(spark, "stream-votes")
    q = vote_counts_stream(src, "user_id", "event_type", "event_id", sink, scratch_path(spark, "stream-ckpt"))
    q.awaitTermination()
    c = spark.read.parquet(sink).groupBy("user_id", "event_type").agg(F.sum("n").alias("votes"), F.min("first").alias("first"))
    w = Window.partitionBy("user_id").orderBy(F.col("votes").desc(), F.col("first"))
    r = c.withColumn("rn", F.row_number().over(w)).withColumn("total", F.sum("votes").over(Window.partitionBy("user_id")))
    return r.where("rn = 1").select("user_id", F.col("event_type").alias("winner"), F.col("total").cast("long").alias("total"),
                                    F.col("votes").cast("long").alias("winner_votes"),
                                    F.round(F.col("votes") / F.col("total"), 6).alias("winner_share"))


QUERIES["events_stream_vote"] = events_stream_vote

_io_oracles_base = oracles


def oracles(learner: dict[str, str]) -> dict[str, str]:  # noqa: F811
    from pairbayes.plans.match_queries import oracles as match_oracles

    o = _io_oracles_base(learner)
    o["events_stream_vote"] = match_oracles()["events_vote"]
    return o
