"""Registered evaluation queries on the histogram model's predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.functions.columns import entropy
from pairbayes.operators import metrics
from pairbayes.operators.binning import pairs_table
from pairbayes.operators.boost import pair_adjacency
from pairbayes.operators.posterior import score
from pairbayes.operators.sampling import split_unit_sql, train_test_split
from pairbayes.plans.learner_queries import BOOST_BINS, EMB_DIMS, _boost_fx, _boost_model, _emb_model
from pairbayes.plans.oracles import boost_base, emb_base, score_ctes

R = 6


def _pred(spark, sf):
    # lineitem: the measures do not determine the flag, so there are errors
    model, fx_y = _boost_model(spark, sf)
    return score(model, fx_y, unique=True), model


def li_confusion_share(spark, sf) -> DataFrame:
    """Row-normalised confusion."""
    s, _ = _pred(spark, sf)
    c = metrics.row_normalised_confusion(metrics.confusion(s))
    return c.select("true_class", "pred_class", "n", F.round("share", R).alias("share"))


def li_misclassified(spark, sf) -> DataFrame:
    """Per true class, counts by wrong predicted class with totals."""
    s, _ = _pred(spark, sf)
    return metrics.misclassification_breakdown(s)


def li_error_examples(spark, sf) -> DataFrame:
    """At most 5 failed rows per true class, lowest ids."""
    s, _ = _pred(spark, sf)
    e = metrics.error_examples(s, 5)
    return e.select("row_id", F.col("y").alias("true_class"), F.col("pred").alias("pred_class"), F.col("rank").cast("int").alias("rank"))


def li_confidence_pages(spark, sf) -> DataFrame:
    """Per predicted class, rank by confidence; page/grid position for
    4x4 pages, top 32 per class (the top-k is the feature)."""
    s, _ = _pred(spark, sf)
    s = s.withColumn("confidence", F.round("confidence", 9))
    p = metrics.confidence_pages(s, 4, 4, top_n=32)
    return p.select("row_id", F.col("pred").alias("pred_class"), F.col("rank").cast("int").alias("rank"), "page", "grid_row", "grid_col")


def li_entropy(spark, sf) -> DataFrame:
    """Max posterior and entropy per row."""
    s, _ = _pred(spark, sf)
    return s.select("row_id", F.round("confidence", R).alias("confidence"),
                    F.round(entropy(F.col("posterior")), R).alias("entropy"))


def li_confusion_weights(spark, sf) -> DataFrame:
    """1 - recall per class, scaled to sum to C."""
    s, m = _pred(spark, sf)
    w = metrics.confusion_class_weights(metrics.confusion(s), m.n_classes)
    return w.select("cls", F.round("weight", R).alias("weight"))


def li_low_posterior(spark, sf) -> DataFrame:
    """P25: rows whose max posterior is below 0.9 (our reading of the
    anomaly threshold setting)."""
    s, _ = _pred(spark, sf)
    return s.where(F.col("confidence") < 0.9).select("row_id", F.col("y").alias("true_class"), F.col("pred").alias("pred_class"))


def emb_pair_adjacency(spark, sf) -> DataFrame:
    """Occupied pairs of the lineitem model that share a feature (a < b), with the
    cells they hold together."""
    model, _ = _boost_model(spark, sf)
    held = model.counts.groupBy("pair_id").agg(F.count(F.lit(1)).alias("cells"))
    pairs = pairs_table(spark, 4).join(held, "pair_id", "left_semi")
    a, b = held.toDF("a", "cells_a"), held.toDF("b", "cells_b")
    return pair_adjacency(pairs).join(a, "a").join(b, "b").select("a", "b", (F.col("cells_a") + F.col("cells_b")).alias("cells"))


def li_split_report(spark, sf) -> DataFrame:
    """W10 + J7/J8: seeded split attached by id; per split accuracy; the test
    set is derived as all rows minus train rows (anti join)."""
    s, _ = _pred(spark, sf)
    sp = train_test_split(s.select("row_id"), "row_id", 0.2, 42)
    train = sp.where(F.col("split") == "train").select("row_id")
    test = s.select("row_id").join(train, "row_id", "left_anti").withColumn("split", F.lit("test"))
    both = train.withColumn("split", F.lit("train")).unionByName(test)
    j = s.join(both, "row_id", "left")
    return j.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                  F.round(F.avg(F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0)), R).alias("accuracy"))


QUERIES = {
    "li_confusion_share": li_confusion_share,
    "li_misclassified": li_misclassified,
    "li_error_examples": li_error_examples,
    "li_confidence_pages": li_confidence_pages,
    "li_entropy": li_entropy,
    "li_confusion_weights": li_confusion_weights,
    "li_low_posterior": li_low_posterior,
    "emb_pair_adjacency": emb_pair_adjacency,
    "li_split_report": li_split_report,
}


def oracles() -> dict[str, str]:
    base = "WITH " + boost_base() + "," + score_ctes("s", None, BOOST_BINS)
    conf = """,
cl AS (SELECT DISTINCT ytrue AS c FROM pred_s UNION SELECT DISTINCT pred FROM pred_s),
cnt AS (SELECT ytrue, pred, count(*) AS n FROM pred_s GROUP BY ytrue, pred),
cm AS (SELECT a.c AS true_class, b.c AS pred_class, coalesce(cnt.n, 0) AS n FROM cl a CROSS JOIN cl b LEFT JOIN cnt ON cnt.ytrue = a.c AND cnt.pred = b.c)"""
    return {
        "li_confusion_share": base + conf + f"""
SELECT true_class, pred_class, n, round(CASE WHEN sum(n) OVER (PARTITION BY true_class) > 0 THEN n * 1.0e0 / sum(n) OVER (PARTITION BY true_class) ELSE 0.0e0 END, {R}) AS share FROM cm""",
        "li_misclassified": base + """,
g AS (SELECT ytrue AS true_class, pred AS pred_class, count(*) AS n FROM pred_s GROUP BY ytrue, pred),
t AS (SELECT *, sum(n) OVER (PARTITION BY true_class) AS total, sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END) OVER (PARTITION BY true_class) AS correct FROM g)
SELECT true_class, pred_class, n, CAST(total AS BIGINT) AS total, CAST(correct AS BIGINT) AS correct FROM t WHERE true_class <> pred_class""",
        "li_error_examples": base + """
SELECT row_id, true_class, pred_class, CAST(rank AS INTEGER) AS rank FROM (SELECT row_id, ytrue AS true_class, pred AS pred_class,
  row_number() OVER (PARTITION BY ytrue ORDER BY row_id) AS rank FROM pred_s WHERE pred <> ytrue) WHERE rank <= 5""",
        "li_confidence_pages": base + """,
r AS (SELECT row_id, pred AS pred_class, CAST(row_number() OVER (PARTITION BY pred ORDER BY round(pmax, 9) DESC, row_id) - 1 AS INTEGER) AS rank FROM pred_s)
SELECT row_id, pred_class, rank, CAST(floor(rank / 16) AS INTEGER) AS page, CAST(floor((rank % 16) / 4) AS INTEGER) AS grid_row,
  CAST(rank % 4 AS INTEGER) AS grid_col FROM r WHERE rank < 32""",
        "li_entropy": base + f""",
h AS (SELECT row_id, -sum(p * ln(p + 1e-10)) AS entropy, max(p) AS confidence FROM post_s GROUP BY row_id)
SELECT row_id, round(confidence, {R}) AS confidence, round(entropy, {R}) AS entropy FROM h""",
        "li_confusion_weights": base + conf + f""",
g AS (SELECT true_class, sum(n) AS tot, sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END) AS tp FROM cm GROUP BY true_class),
w AS (SELECT true_class, 1.0e0 - tp * 1.0e0 / CASE WHEN tot = 0 THEN 1 ELSE tot END AS w FROM g)
SELECT true_class AS cls, round(CASE WHEN sum(w) OVER () > 0 THEN w * (SELECT count(*) FROM ncls) / sum(w) OVER () ELSE 1.0e0 END, {R}) AS weight FROM w""",
        "li_low_posterior": base + """
SELECT row_id, ytrue AS true_class, pred AS pred_class FROM pred_s WHERE pmax < 0.9e0""",
        "emb_pair_adjacency": "WITH " + boost_base() + """,
lp AS (SELECT pair_id, f1 AS f FROM pairs UNION ALL SELECT pair_id, f2 FROM pairs),
h AS (SELECT pair_id, count(*) AS cells FROM counts GROUP BY pair_id),
ad AS (SELECT DISTINCT l.pair_id AS a, r.pair_id AS b FROM lp l JOIN lp r ON l.f = r.f AND l.pair_id < r.pair_id)
SELECT a, b, ha.cells + hb.cells AS cells FROM ad JOIN h ha ON ha.pair_id = a JOIN h hb ON hb.pair_id = b""",
        "li_split_report": base + f""",
sp AS (SELECT row_id, CASE WHEN {split_unit_sql('row_id')} < 0.8e0 THEN 'train' ELSE 'test' END AS split FROM pred_s)
SELECT split, count(*) AS n, round(avg(CASE WHEN p.pred = p.ytrue THEN 1.0e0 ELSE 0.0e0 END), {R}) AS accuracy
FROM pred_s p JOIN sp ON sp.row_id = p.row_id GROUP BY split""",
    }


def li_failed_margins(spark, sf) -> DataFrame:
    """Margins of failed rows, mandatory top-2 per class."""
    from pairbayes.operators.active import failed_margins

    s, _ = _pred(spark, sf)
    f = failed_margins(s)
    return f.select("row_id", F.col("y").alias("true_class"), F.round("margin", R).alias("margin"),
                    F.col("margin_rank").cast("int").alias("margin_rank"), "mandatory")


def li_active_selection(spark, sf) -> DataFrame:
    """One selection round over every failed row."""
    from pairbayes.operators.active import select_samples

    model, fx_y = _boost_model(spark, sf)
    s = score(model, fx_y, unique=True)
    sizes = fx_y.groupBy("y").agg(F.count(F.lit(1)).alias("n"))  # every row is scored once
    return select_samples(s, fx_y, sizes, 4)


def li_adaptive_rounds(spark, sf) -> DataFrame:
    """Adaptive training rounds from two seed rows per class; the round
    log (rows-only check)."""
    from pairbayes.operators.features import feature_frame
    from pairbayes.plans.train import adaptive_fit
    from pairbayes.session import table

    fx = _boost_fx(spark, sf)
    _, _, log = adaptive_fit(fx, n_bins=BOOST_BINS, epochs=2, rounds=3, patience=2, unique=True)
    return log


def part_divergent_rows(spark, sf) -> DataFrame:
    """J10 + B9's walk: the parts of a brand that stand apart in size, price and name length, and its diameter."""
    from pairbayes.operators.encode import encode_labels
    from pairbayes.operators.leaders import diameters, leaders
    from pairbayes.session import table

    p = table(spark, sf, "part")
    brands = [r[0] for r in p.select("p_brand").distinct().orderBy("p_brand").collect()]
    x = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 50, F.length("p_name").cast("double"))
    rows = encode_labels(p.select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("label"), x.alias("x")), brands).select("row_id", "y", "x")
    wide = diameters(rows, 3)
    size = spark.createDataFrame([(y, brands[y], d) for y, d in wide.items()], "y int, p_brand string, diameter double")
    return leaders(rows, 3).join(size, "y").select("p_brand", "leader", "row_id", F.round("diameter", R).alias("diameter"))


QUERIES.update({
    "part_divergent_rows": part_divergent_rows,
    "li_failed_margins": li_failed_margins,
    "li_active_selection": li_active_selection,
    "li_adaptive_rounds": li_adaptive_rounds,
})

_base_oracles = oracles


def greedy_sql(rows: str, n: int) -> str:
    """CTEs down to ``chosen`` (row_id, y, leader) of ``rows`` (row_id, y, e): all pairs for the
    diameter, then one leader a class and step."""
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
    d = lambda a, b: "(" + " + ".join(f"sqrt(({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}]) + ({a}[{j}] - {b}[{j}]) * ({a}[{j}] - {b}[{j}]))" for i, j in pairs) + f") / {len(pairs)}.0e0"
    return f"""pts AS MATERIALIZED (SELECT DISTINCT y, e FROM {rows}),
mid AS (SELECT y, list(m ORDER BY f) AS c FROM (SELECT y, f, avg(e[f]) AS m FROM pts, range(1, {n + 1}) t(f) GROUP BY y, f) GROUP BY y),
out AS MATERIALIZED (SELECT p.y, p.e, {d('p.e', 'm.c')} AS r FROM pts p JOIN mid m USING (y)),
edge AS (SELECT y, arg_max(e, r) AS a, max(r) AS rmax FROM out GROUP BY y),
low AS (SELECT o.y, max({d('o.e', 'g.a')}) AS d0, max(g.rmax) AS rmax FROM out o JOIN edge g USING (y) GROUP BY o.y),
far AS MATERIALIZED (SELECT o.y, o.e FROM out o JOIN low USING (y) WHERE o.r >= (d0 - rmax) * 0.999999e0),
wide AS (SELECT a.y, max({d('a.e', 'b.e')}) AS d FROM far a JOIN far b USING (y) GROUP BY a.y),
lim AS MATERIALIZED (SELECT y, CASE WHEN d > 0 THEN 0.1e0 * (d + 1e-7 * {len(pairs)}) ELSE 1e300 END AS eps FROM wide),
walk(row_id, y, e, lead, le) AS (
  SELECT row_id, y, e, min(row_id) OVER (PARTITION BY y), arg_min(e, row_id) OVER (PARTITION BY y) FROM {rows}
  UNION ALL
  SELECT row_id, y, e, min(row_id) OVER (PARTITION BY y), arg_min(e, row_id) OVER (PARTITION BY y)
  FROM (SELECT w.row_id, w.y, w.e FROM walk w JOIN lim USING (y) WHERE {d('w.e', 'w.le')} >= lim.eps)),
lead AS (SELECT DISTINCT y, lead, le FROM walk),
chosen AS (SELECT min(c.row_id) AS row_id, c.y, l.lead AS leader FROM lead l JOIN {rows} c USING (y) JOIN lim USING (y)
           WHERE {d('c.e', 'l.le')} < lim.eps GROUP BY c.y, l.lead)"""


def oracles() -> dict[str, str]:  # noqa: F811
    o = _base_oracles()
    o["li_failed_margins"] = "WITH " + boost_base() + "," + score_ctes("s", None, BOOST_BINS) + f""",
f AS (SELECT row_id, ytrue AS true_class, pmax - ptrue AS margin FROM pred_s WHERE pred <> ytrue),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY true_class ORDER BY round(margin, 9) DESC, row_id) AS INTEGER) AS margin_rank FROM f)
SELECT row_id, true_class, round(margin, {R}) AS margin, margin_rank, margin_rank <= 2 AS mandatory FROM r"""
    o["part_divergent_rows"] = f"""WITH RECURSIVE cand AS MATERIALIZED (SELECT p_partkey AS row_id, p_brand AS y,
  [CAST(p_size AS DOUBLE), p_retailprice / 50, CAST(length(p_name) AS DOUBLE)] AS e FROM part),
{greedy_sql("cand", 3)}
SELECT c.y AS p_brand, leader, row_id, round(w.d, {R}) AS diameter FROM chosen c JOIN wide w USING (y)"""
    o["li_active_selection"] = "WITH RECURSIVE " + boost_base() + "," + score_ctes("s", None, BOOST_BINS) + """,
r AS (SELECT row_id, ytrue AS y, row_number() OVER (PARTITION BY ytrue ORDER BY round(pmax - ptrue, 9) DESC, row_id) AS rn FROM pred_s WHERE pred <> ytrue),
cand AS MATERIALIZED (SELECT s.row_id, r.y, s.e FROM src s JOIN r ON r.row_id = s.row_id WHERE r.rn > 2),
""" + greedy_sql("cand", 4) + """,
sel AS (SELECT row_id, y FROM r WHERE rn <= 2 UNION SELECT row_id, y FROM chosen),
n AS (SELECT ytrue AS y, count(*) AS n FROM pred_s GROUP BY ytrue),
k AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY row_id) AS rn FROM sel)
SELECT k.row_id, k.y FROM k JOIN n ON n.y = k.y WHERE rn <= greatest(2, floor(n * 0.99e0))"""
    return o
