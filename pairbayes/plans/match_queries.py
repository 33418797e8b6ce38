"""Registered matching / spectrum / vote queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.functions.columns import row_minmax
from pairbayes.operators.match import majority_vote, nearest_point, tolerance_join_cols, tolerance_vote
from pairbayes.operators.metrics import binary_metrics
from pairbayes.session import table
from pairbayes.sources.spectra import mean_std_by_position, parse_spectrum, spectrum_text, to_columns

R = 6
DIM = 64


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def spec_parse(spark, sf) -> DataFrame:
    """P15 + P16: spectra written as bracketed text (element 0 as DC), parsed
    back with the DC dropped, flattened to Power_1..Power_63."""
    e = _emb(spark, sf).withColumn("txt", spectrum_text(F.col("e")))
    p = e.select("vec_id", "label", parse_spectrum(F.col("txt"), drop_first=True, length=DIM - 1).alias("power"))
    p = p.where(F.col("power").isNotNull())
    return to_columns(p, "power", DIM - 1, keep=("vec_id", "label")).select(
        "vec_id", "label", *[F.round(f"Power_{i}", R).alias(f"Power_{i}") for i in range(1, DIM)]
    )


def spec_row_minmax(spark, sf) -> DataFrame:
    """Per-row (x-min)/(max-min), constant rows -> 0, 8 decimals."""
    e = _emb(spark, sf).withColumn("m", row_minmax(F.col("e")))
    return to_columns(e, "m", DIM, keep=("vec_id",)).select(
        "vec_id", *[F.round(f"Power_{i}", 8).alias(f"Power_{i}") for i in range(1, DIM + 1)]
    )


def spec_mean_std(spark, sf) -> DataFrame:
    """Mean and population std per label and position."""
    m = mean_std_by_position(_emb(spark, sf), "label", "e")
    return m.select("label", F.col("pos").cast("int").alias("pos"), F.round("mean", R).alias("mean"),
                    F.round("std", R).alias("std"))


def spec_tolerance_matches(spark, sf) -> DataFrame:
    """(source, prediction row) pairs within tolerance, same label."""
    m = tolerance_join_cols(*_spectra(spark, sf), "label", "__sv", "__pv")
    return m.select("s_name", "label", "row_id", "predicted_class")


def _spectra(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Sources (rounded spectra) and predictions; each side's vector has a name of its own."""
    e = _emb(spark, sf)
    sources = e.select(F.concat(F.lit("src_"), F.col("vec_id").cast("string")).alias("s_name"), "label",
                       F.transform("e", lambda v: F.round(v, 6)).alias("__sv"))
    preds = e.select(F.col("vec_id").alias("row_id"), "label", F.col("e").alias("__pv"),
                     (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("predicted_class"))
    return sources, preds


def spec_vote(spark, sf) -> DataFrame:
    """J3 + A14: majority predicted class per source over its matches."""
    sources, preds = _spectra(spark, sf)
    v = tolerance_vote(sources, preds, "label", "__sv", "__pv", "s_name", "predicted_class", "row_id")
    return v.join(sources.select("s_name", F.col("label").alias("true_label")), "s_name").select(
        "s_name", "true_label", "winner", "total", "winner_votes", F.round("winner_share", R).alias("winner_share"))


def spec_vote_metrics(spark, sf) -> DataFrame:
    """Binary metrics of winner vs true label (positive class 1)."""
    v = spec_vote(spark, sf)
    m = binary_metrics(v, "true_label", "winner", 1)
    return m.select("n", "tp", "fp", "fn", *[F.round(c, R).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def events_vote(spark, sf) -> DataFrame:
    """A14 on events: each user's majority event type, ties -> first met."""
    e = table(spark, sf, "events")
    v = majority_vote(e, "user_id", "event_type", "event_id")
    return v.select("user_id", "winner", "total", "winner_votes", F.round("winner_share", R).alias("winner_share"))


def nearest_customer(spark, sf) -> DataFrame:
    """Nearest customer (c_acctbal, c_nationkey) to every supplier
    (s_acctbal, s_nationkey); flat distance, ties to the smaller c_name."""
    s = table(spark, sf, "supplier").select("s_name", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    c = table(spark, sf, "customer").select("c_name", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    r = nearest_point(s, c, "s_name", "x", "y", "c_name", "x", "y")
    return r.select("s_name", "c_name", F.round("distance", R).alias("distance"))


QUERIES = {
    "spec_parse": spec_parse,
    "spec_row_minmax": spec_row_minmax,
    "spec_mean_std": spec_mean_std,
    "spec_tolerance_matches": spec_tolerance_matches,
    "spec_vote": spec_vote,
    "spec_vote_metrics": spec_vote_metrics,
    "events_vote": events_vote,
    "nearest_customer": nearest_customer,
}


_NORM = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


def _matches_sql() -> str:
    return f"""
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT 'src_' || CAST(vec_id AS VARCHAR) AS s_name, label, list_transform(e, lambda x: round(x, 6)) AS v FROM e),
p AS (SELECT vec_id AS row_id, label, e AS v,
      CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS predicted_class FROM e),
sn AS (SELECT s_name, label, {_NORM.format(v='v')} AS v FROM s),
pn AS (SELECT row_id, label, predicted_class, {_NORM.format(v='v')} AS v FROM p),
m AS (SELECT sn.s_name, sn.label, pn.row_id, pn.predicted_class FROM sn JOIN pn ON sn.label = pn.label
      WHERE len(sn.v) = len(pn.v)
        AND list_bool_and(list_transform(list_zip(sn.v, pn.v), lambda z: abs(z[1] - z[2]) <= 1e-5 + 1e-5 * abs(z[2]))))"""


def oracles() -> dict[str, str]:
    pw = ", ".join(f"round(pw[{i}], {R}) AS Power_{i}" for i in range(1, DIM))
    mm = ", ".join(f"round(CASE WHEN hi = lo THEN 0.0e0 ELSE (e[{i}] - lo) / (hi - lo) END, 8) AS Power_{i}" for i in range(1, DIM + 1))
    vote = f"""WITH {_matches_sql()},
g AS (SELECT s_name, predicted_class, count(*) AS votes, min(row_id) AS first FROM m GROUP BY s_name, predicted_class),
r AS (SELECT *, row_number() OVER (PARTITION BY s_name ORDER BY votes DESC, first) AS rn, sum(votes) OVER (PARTITION BY s_name) AS total FROM g),
lab AS (SELECT s_name, min(label) AS true_label FROM m GROUP BY s_name),
v AS (SELECT r.s_name, lab.true_label, r.predicted_class AS winner, CAST(r.total AS BIGINT) AS total, r.votes AS winner_votes,
             r.votes * 1.0e0 / r.total AS winner_share FROM r JOIN lab ON lab.s_name = r.s_name WHERE rn = 1)"""
    return {
        "spec_parse": f"""SELECT vec_id, label, {pw} FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[])[2:] AS pw FROM embeddings)""",
        "spec_row_minmax": f"""SELECT vec_id, {mm} FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_min(CAST(embedding AS DOUBLE[])) AS lo, list_max(CAST(embedding AS DOUBLE[])) AS hi FROM embeddings)""",
        "spec_mean_std": f"""SELECT label, CAST(t.i - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[t.i] AS DOUBLE)), {R}) AS mean,
  round(stddev_pop(CAST(embedding[t.i] AS DOUBLE)), {R}) AS std FROM embeddings CROSS JOIN range(1, {DIM + 1}) t(i) GROUP BY label, t.i""",
        "spec_tolerance_matches": f"WITH {_matches_sql()} SELECT s_name, label, row_id, predicted_class FROM m",
        "spec_vote": vote + f" SELECT s_name, true_label, winner, total, winner_votes, round(winner_share, {R}) AS winner_share FROM v",
        "spec_vote_metrics": vote + f""",
a AS (SELECT count(*) AS n, CAST(sum(CASE WHEN true_label = 1 AND winner = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
      CAST(sum(CASE WHEN true_label <> 1 AND winner = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
      CAST(sum(CASE WHEN true_label = 1 AND winner <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
      sum(CASE WHEN true_label = winner THEN 1 ELSE 0 END) AS correct FROM v),
b AS (SELECT *, CASE WHEN n > 0 THEN correct * 1.0e0 / n ELSE 0.0e0 END AS accuracy,
      CASE WHEN tp + fp > 0 THEN tp * 1.0e0 / (tp + fp) ELSE 0.0e0 END AS precision,
      CASE WHEN tp + fn > 0 THEN tp * 1.0e0 / (tp + fn) ELSE 0.0e0 END AS recall FROM a)
SELECT n, tp, fp, fn, round(accuracy, {R}) AS accuracy, round(precision, {R}) AS precision, round(recall, {R}) AS recall,
  round(CASE WHEN precision + recall > 0 THEN 2.0e0 * precision * recall / (precision + recall) ELSE 0.0e0 END, {R}) AS f1 FROM b""",
        "events_vote": f"""WITH g AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS first FROM events GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) AS rn, sum(votes) OVER (PARTITION BY user_id) AS total FROM g)
SELECT user_id, event_type AS winner, CAST(total AS BIGINT) AS total, votes AS winner_votes, round(votes * 1.0e0 / total, {R}) AS winner_share FROM r WHERE rn = 1""",
        "nearest_customer": f"""WITH d AS (SELECT s.s_name, c.c_name,
   (c.c_acctbal - s.s_acctbal) * (c.c_acctbal - s.s_acctbal) + (CAST(c.c_nationkey AS DOUBLE) - CAST(s.s_nationkey AS DOUBLE)) * (CAST(c.c_nationkey AS DOUBLE) - CAST(s.s_nationkey AS DOUBLE)) AS d2
   FROM supplier s CROSS JOIN customer c),
r AS (SELECT *, row_number() OVER (PARTITION BY s_name ORDER BY d2, c_name) AS rn FROM d)
SELECT s_name, c_name, round(sqrt(d2), {R}) AS distance FROM r WHERE rn = 1""",
    }
