"""Registered embedding/class analytics queries and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.operators import embed
from pairbayes.operators.binning import pair_order
from pairbayes.operators.metrics import nmi
from pairbayes.plans.learner_queries import EMB_DIMS, _emb, _emb_model
from pairbayes.operators.posterior import score
from pairbayes.plans.oracles import emb_base, score_ctes
from pairbayes.session import cut_lineage

R = 6
FULL = 64
SAMPLED = 300


def emb_label_corr(spark, sf) -> DataFrame:
    fx_y, _ = _emb(spark, sf, FULL)
    return embed.label_correlation(fx_y).select("feature", F.round("corr", R).alias("corr"))


def emb_feature_corr(spark, sf) -> DataFrame:
    fx_y, _ = _emb(spark, sf, EMB_DIMS)
    return embed.feature_correlation(fx_y, None, EMB_DIMS).select("f1", "f2", F.round("corr", R).alias("corr"))


def emb_sampled_pairs(spark, sf) -> DataFrame:
    """W12 + A19: correlations of a seeded sample of 300 of the 2,016 feature pairs."""
    from pairbayes.operators.binning import pairs_table

    fx_y, _ = _emb(spark, sf, FULL)
    every = embed.feature_correlation(fx_y, None, FULL)
    return pairs_table(spark, FULL, SAMPLED).join(every, ["f1", "f2"]).select("pair_id", "f1", "f2", F.round("corr", R).alias("corr"))


def emb_class_separation(spark, sf) -> DataFrame:
    fx_y, _ = _emb(spark, sf, FULL)
    s = embed.class_separation(fx_y)
    return s.select("feature", F.round("score", R).alias("score"), F.round("score_norm", R).alias("score_norm"))


def emb_class_cosine(spark, sf) -> DataFrame:
    fx_y, _ = _emb(spark, sf, FULL)
    return embed.class_mean_cosine(fx_y).select("class_a", "class_b", F.round("cosine", R).alias("cosine"))


def emb_gaussian_kl(spark, sf) -> DataFrame:
    fx_y, _ = _emb(spark, sf, FULL)
    k = embed.gaussian_kl(fx_y)
    return k.select("class_i", "class_j", F.round("kl", 4).alias("kl"))


def emb_reconstruction(spark, sf) -> DataFrame:
    """B20 + A16: expected feature vector under the histogram posterior;
    per true class mean squared error."""
    model, fx_y = _emb_model(spark, sf)
    M = embed.class_means_matrix(fx_y, model.n_classes, EMB_DIMS)
    s = score(model, fx_y).join(fx_y.select("row_id", "x"), "row_id")
    e = embed.reconstruction_errors(embed.reconstruct(s, M))
    return e.groupBy(F.col("y").alias("true_class")).agg(F.round(F.avg("mse"), R).alias("mse"),
                                                        F.count(F.lit(1)).alias("n"))


def _inverted(spark, sf) -> DataFrame:
    """Rows with their features, posterior and the features that the learned inverse gives back."""
    from pairbayes.operators import inverse

    model, fx_y = _emb_model(spark, sf)
    s = cut_lineage(score(model, fx_y).select("row_id", "posterior").join(fx_y.select("row_id", "x"), "row_id"))
    return inverse.invert(s, inverse.fit_inverse(s, model.n_classes, EMB_DIMS))


def emb_inverse_losses(spark, sf) -> DataFrame:
    """The three loss terms of the learned inverse and their sum."""
    from pairbayes.operators.inverse import losses

    # the divergence is large and its system's inverse is a long sum: four decimals
    return losses(_inverted(spark, sf)).select(*[F.round(c, 4).alias(c) for c in ("mse", "corr", "kl", "total")])


def emb_inverse_errors(spark, sf) -> DataFrame:
    """Squared error per feature, and over all rows (feature -1)."""
    from pairbayes.operators.inverse import feature_errors

    e = feature_errors(_inverted(spark, sf))
    return e.select("feature", "n", F.round("mse", R).alias("mse"), F.round("std", R).alias("std"))


def emb_nmi(spark, sf) -> DataFrame:
    """NMI between labels and histogram predictions."""
    model, fx_y = _emb_model(spark, sf)
    n = nmi(score(model, fx_y), "y", "pred")
    return n.select(*[F.round(c, R).alias(c) for c in ("mi", "h_a", "h_b", "nmi")])


def emb_contrastive(spark, sf) -> DataFrame:
    """Contrastive score per row within batches of 128 consecutive ids."""
    fx_y, _ = _emb(spark, sf, FULL)
    c = embed.contrastive_scores(fx_y, 128, 0.5)
    return c.select("row_id", "bucket", F.round("score", R).alias("score"))


def emb_kmeans(spark, sf) -> DataFrame:
    """KMeans (k = class count) on L2-normalised embeddings; rows-only."""
    fx_y, classes = _emb(spark, sf, FULL)
    model, cl = embed.kmeans_clusters(fx_y, len(classes))
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    soft = embed.soft_assignment(fx_y, centres)
    return cl.join(soft.select("row_id", F.array_max("p").alias("p_max")), "row_id")


def emb_soft_clusters(spark, sf) -> DataFrame:
    """Student-t assignment of every vector to the class means, its target share, and the
    divergence of all targets."""
    fx_y, classes = _emb(spark, sf, FULL)
    means = embed.class_means_matrix(fx_y, len(classes), FULL)
    rows, loss = embed.student_assignment(fx_y, means)
    kl = loss.first()["kl"]
    return rows.select("row_id", "cluster", F.round("confidence", R).alias("confidence"), F.round(F.array_max("p"), R).alias("target"), F.round(F.lit(kl), R).alias("kl"))


def emb_pca(spark, sf) -> DataFrame:
    """Scores on 2 principal components scaled to [-1, 1], with their shares of the variance."""
    fx_y, _ = _emb(spark, sf, FULL)
    p = embed.pca_scores(fx_y, 2, FULL)
    return p.select("row_id", *[F.round(c, 5).alias(c) for c in ("pc1", "pc2", "ev1", "ev2")])


def emb_pca_loadings(spark, sf) -> DataFrame:
    """Loadings of the 2 components."""
    from pairbayes.operators.gram import principal_components

    fx_y, _ = _emb(spark, sf, FULL)
    return principal_components(fx_y, FULL, 2).frame(spark).select("component", "feature", F.round("loading", 5).alias("loading"))


QUERIES = {
    "emb_label_corr": emb_label_corr,
    "emb_feature_corr": emb_feature_corr,
    "emb_sampled_pairs": emb_sampled_pairs,
    "emb_class_separation": emb_class_separation,
    "emb_class_cosine": emb_class_cosine,
    "emb_gaussian_kl": emb_gaussian_kl,
    "emb_reconstruction": emb_reconstruction,
    "emb_inverse_losses": emb_inverse_losses,
    "emb_inverse_errors": emb_inverse_errors,
    "emb_nmi": emb_nmi,
    "emb_contrastive": emb_contrastive,
    "emb_kmeans": emb_kmeans,
    "emb_soft_clusters": emb_soft_clusters,
    "emb_pca": emb_pca,
    "emb_pca_loadings": emb_pca_loadings,
}


def _long(dims: int) -> str:
    return f"""lf AS (SELECT vec_id AS row_id, label AS y, CAST(t.i - 1 AS INTEGER) AS feature, CAST(embedding[t.i] AS DOUBLE) AS v
       FROM embeddings CROSS JOIN range(1, {dims + 1}) t(i))"""


def _pca_sql() -> str:
    """CTEs down to comp (component, v, ev): the correlation matrix squared 16 times, by trace, gives
    the first eigenvector; taken off the matrix, the second."""
    square = lambda n: (f"{n}(k, p) AS (SELECT 0, m FROM {n}0 UNION ALL SELECT k + 1, list_transform(q, lambda r: list_transform(r, lambda x: x / t)) "  # noqa: E731
                        "FROM (SELECT k, q, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i][i])) AS t FROM "
                        f"(SELECT k, list_transform(p, lambda r: list_transform(p, lambda c: list_dot_product(r, c))) AS q FROM {n} WHERE k < 16)))")
    first = lambda n, name: (f"{name} AS (SELECT list_transform(r, lambda x: x / s) AS v FROM (SELECT r, sqrt(list_dot_product(r, r)) * CASE WHEN "  # noqa: E731
                             "list_max(r) >= -list_min(r) THEN 1 ELSE -1 END AS s FROM (SELECT unnest(p) AS r FROM " f"{n} WHERE k = 16) ORDER BY list_dot_product(r, r) DESC LIMIT 1))")
    return f"""{_long(FULL)},
st AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM lf GROUP BY feature),
z AS (SELECT row_id, list((v - m) / s ORDER BY feature) AS z FROM lf JOIN st USING (feature) GROUP BY row_id),
co AS (SELECT a.feature AS i, b.feature AS j, corr(a.v, b.v) AS c FROM lf a JOIN lf b ON a.row_id = b.row_id GROUP BY a.feature, b.feature),
a0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM co GROUP BY i)),
{square('a')}, {first('a', 'v1')},
l1 AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS lam FROM v1, a0),
b0 AS MATERIALIZED (SELECT list_transform(range(1, {FULL + 1}), lambda i: list_transform(range(1, {FULL + 1}), lambda j: m[i][j] - lam * v[i] * v[j])) AS m FROM l1, a0),
{square('b')}, {first('b', 'v2')},
l2 AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS lam FROM v2, a0),
comp AS (SELECT 0 AS component, v, lam / {FULL} AS ev FROM l1 UNION ALL SELECT 1, v, lam / {FULL} FROM l2)"""


def _inverse_sql() -> str:
    """CTEs down to xh (row_id, f, v, xh): normal equations, their inverse by Newton steps on lists."""
    return emb_base() + "," + score_ctes("s", None) + f""",
zz AS (SELECT row_id, 0 AS k, 1.0e0 AS z FROM pred_s UNION ALL SELECT row_id, cls + 1, p FROM post_s),
am AS (SELECT a.k AS i, b.k AS j, sum(a.z * b.z) + CASE WHEN a.k = b.k AND a.k > 0 THEN 1 ELSE 0 END AS s FROM zz a JOIN zz b ON a.row_id = b.row_id GROUP BY a.k, b.k),
aa AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM am GROUP BY i)),
inv(t, x) AS (SELECT 0, list_transform(m, lambda r: list_transform(r, lambda v: v / (n * n))) FROM (SELECT m, list_max(list_transform(m, lambda r: list_sum(list_transform(r, lambda v: abs(v))))) AS n FROM aa)
  UNION ALL SELECT t + 1, list_transform(x, lambda r, i: list_transform(y, lambda c, j: 2 * r[j] - list_dot_product(r, c)))
  FROM (SELECT t, x, list_transform(x, lambda c: list_transform(m, lambda r: list_dot_product(r, c))) AS y FROM inv, aa WHERE t < 40)),
bm AS (SELECT k, f, sum(z * v) AS s FROM zz JOIN feat USING (row_id) GROUP BY k, f),
bl AS (SELECT f, list(s ORDER BY k) AS b FROM bm GROUP BY f),
w AS MATERIALIZED (SELECT f, list_transform(x, lambda r: list_dot_product(r, b)) AS w FROM bl, inv WHERE t = 40),
zl AS (SELECT row_id, list(z ORDER BY k) AS z FROM zz GROUP BY row_id),
xh AS MATERIALIZED (SELECT x.row_id, x.f, x.v, list_dot_product(z, w.w) AS xh FROM feat x JOIN zl ON zl.row_id = x.row_id JOIN w ON w.f = x.f)"""


def oracles() -> dict[str, str]:
    _, step, start = pair_order(FULL, SAMPLED)
    norm = "list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))"
    return {
        "emb_soft_clusters": f"""WITH {_long(FULL)},
m AS (SELECT y AS c, feature, avg(v) AS m FROM lf GROUP BY y, feature),
mn AS (SELECT c, list(m ORDER BY feature) AS m FROM m GROUP BY c), xn AS (SELECT row_id, list(v ORDER BY feature) AS x FROM lf GROUP BY row_id),
d AS (SELECT row_id, c, 1 / (1 + 2 * (1 - list_dot_product(x, m) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(m, m)))) + 1e-8) AS t FROM xn, mn),
q AS (SELECT row_id, c, t / (sum(t) OVER (PARTITION BY row_id) + 1e-8) AS q FROM d),
u AS (SELECT row_id, c, q, q * q / (sum(q) OVER (PARTITION BY c) + 1e-8) AS u FROM q),
p AS (SELECT row_id, c, q, u / (sum(u) OVER (PARTITION BY row_id) + 1e-8) AS p FROM u),
l AS (SELECT sum(p * (ln(p) - ln(q + 1e-8))) / count(DISTINCT row_id) AS kl FROM p)
SELECT row_id, CAST(arg_max(c, q) AS INTEGER) AS cluster, round(max(q), {R}) AS confidence, round(max(p), {R}) AS target, round(any_value(kl), {R}) AS kl FROM p, l GROUP BY row_id""",
        "emb_sampled_pairs": f"""WITH {_long(FULL)},
num AS (SELECT a.i AS f1, b.i AS f2, row_number() OVER (ORDER BY a.i, b.i) - 1 AS pair_id FROM range(0, {FULL}) a(i) JOIN range(0, {FULL}) b(i) ON a.i < b.i),
pick AS (SELECT DISTINCT (t * {step} + {start}) % {FULL * (FULL - 1) // 2} AS pair_id FROM range(0, {SAMPLED}) r(t))
SELECT CAST(pair_id AS INTEGER) AS pair_id, CAST(f1 AS INTEGER) AS f1, CAST(f2 AS INTEGER) AS f2, round(corr(a.v, b.v), {R}) AS corr
FROM pick JOIN num USING (pair_id) JOIN lf a ON a.feature = f1 JOIN lf b ON b.feature = f2 AND b.row_id = a.row_id GROUP BY pair_id, f1, f2""",
        "emb_inverse_errors": f"""WITH RECURSIVE {_inverse_sql()}, pr AS (SELECT row_id, avg((v - xh) * (v - xh)) AS mse FROM xh GROUP BY row_id)
SELECT f AS feature, count(*) AS n, round(avg((v - xh) * (v - xh)), {R}) AS mse, CAST(NULL AS DOUBLE) AS std FROM xh GROUP BY f
UNION ALL SELECT -1, count(*), round(avg(mse), {R}), round(stddev_samp(mse), {R}) FROM pr""",
        "emb_inverse_losses": f"""WITH RECURSIVE {_inverse_sql()},
sc AS (SELECT f, min(v) AS lo, CASE WHEN max(v) > min(v) THEN max(v) - min(v) ELSE 1 END AS g FROM xh GROUP BY f),
s AS (SELECT row_id, f, (v - lo) / g AS a, (xh - lo) / g AS b FROM xh JOIN sc USING (f)),
st AS (SELECT f, avg(a) AS ma, avg(b) AS mb, stddev_samp(a) + 1e-8 AS sa, stddev_samp(b) + 1e-8 AS sb FROM s GROUP BY f),
r AS (SELECT row_id, avg((a - b) * (a - b)) AS mse, -sum((a - ma) * (b - mb)) / (sqrt(sum((a - ma) * (a - ma))) * sqrt(sum((b - mb) * (b - mb))) + 1e-8) AS corr FROM s JOIN st USING (f) GROUP BY row_id),
k AS (SELECT avg(ln(sb / sa) + (sa * sa + (ma - mb) * (ma - mb)) / (2 * sb * sb) - 0.5e0) AS kl FROM st),
t AS (SELECT avg(mse) AS mse, avg(corr) AS corr, any_value(kl) AS kl FROM r, k)
SELECT round(mse, 4) AS mse, round(corr, 4) AS corr, round(kl, 4) AS kl, round(mse + 0.1e0 * corr + 0.01e0 * kl, 4) AS total FROM t""",
        "emb_pca_loadings": f"WITH RECURSIVE {_pca_sql()} SELECT CAST(component AS INTEGER) AS component, CAST(t.f - 1 AS INTEGER) AS feature, round(v[t.f], 5) AS loading FROM comp CROSS JOIN range(1, {FULL + 1}) t(f)",
        "emb_pca": f"""WITH RECURSIVE {_pca_sql()},
s AS (SELECT row_id, component, list_dot_product(z, v) AS pc, ev FROM z, comp),
w AS (SELECT row_id, component, ev, 2 * (pc - min(pc) OVER (PARTITION BY component)) / (max(pc) OVER (PARTITION BY component) - min(pc) OVER (PARTITION BY component)) - 1 AS pc FROM s)
SELECT a.row_id, round(a.pc, 5) AS pc1, round(b.pc, 5) AS pc2, round(a.ev, 5) AS ev1, round(b.ev, 5) AS ev2
FROM w a JOIN w b ON a.row_id = b.row_id AND a.component = 0 AND b.component = 1""",
        "emb_label_corr": f"WITH {_long(FULL)} SELECT feature, round(corr(v, CAST(y AS DOUBLE)), {R}) AS corr FROM lf GROUP BY feature",
        "emb_feature_corr": f"""WITH {_long(EMB_DIMS)}
SELECT a.feature AS f1, b.feature AS f2, round(corr(a.v, b.v), {R}) AS corr FROM lf a JOIN lf b ON a.row_id = b.row_id AND a.feature < b.feature GROUP BY a.feature, b.feature""",
        "emb_class_separation": f"""WITH {_long(FULL)},
s AS (SELECT y, feature, count(v) AS n, avg(v) AS mean, var_pop(v) AS vp FROM lf GROUP BY y, feature),
m AS (SELECT *, sum(n * mean) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS mu FROM s),
g AS (SELECT feature, sum(n * (mean - mu) * (mean - mu)) AS between, sum(n * vp) AS within FROM m GROUP BY feature),
h AS (SELECT feature, CASE WHEN within > 0 THEN between / within ELSE between END AS score FROM g)
SELECT feature, round(score, {R}) AS score, round(CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE score END, {R}) AS score_norm FROM h""",
        "emb_class_cosine": f"""WITH {_long(FULL)},
m AS (SELECT y, feature, avg(v) AS m FROM lf GROUP BY y, feature)
SELECT a.y AS class_a, b.y AS class_b, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), {R}) AS cosine
FROM m a JOIN m b ON a.feature = b.feature AND a.y < b.y GROUP BY a.y, b.y""",
        "emb_gaussian_kl": f"""WITH n AS (SELECT vec_id, label AS y, {norm} AS e FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
lf AS (SELECT y, CAST(t.i - 1 AS INTEGER) AS feature, e[t.i] AS v FROM n CROSS JOIN range(1, {FULL + 1}) t(i)),
s AS (SELECT y, feature, avg(v) AS m, var_pop(v) + 1e-6 AS var FROM lf GROUP BY y, feature)
SELECT a.y AS class_i, b.y AS class_j,
  round(sum(0.5e0 * (ln(b.var + 1e-6) - ln(a.var + 1e-6)) + 0.5e0 * (a.var + (a.m - b.m) * (a.m - b.m)) / (b.var + 1e-6) - 0.5e0), 4) AS kl
FROM s a JOIN s b ON a.feature = b.feature AND a.y < b.y GROUP BY a.y, b.y""",
        "emb_reconstruction": "WITH " + emb_base() + "," + score_ctes("s", None) + f""",
cm AS (SELECT y, f, avg(v) AS mu FROM feat GROUP BY y, f),
xh AS (SELECT p.row_id, cm.f, sum(p.p * cm.mu) AS xh FROM post_s p JOIN cm ON cm.y = p.cls GROUP BY p.row_id, cm.f),
er AS (SELECT x.row_id, x.y, avg((x.v - xh.xh) * (x.v - xh.xh)) AS mse FROM feat x JOIN xh ON xh.row_id = x.row_id AND xh.f = x.f GROUP BY x.row_id, x.y)
SELECT y AS true_class, round(avg(mse), {R}) AS mse, count(*) AS n FROM er GROUP BY y""",
        "emb_nmi": "WITH " + emb_base() + "," + score_ctes("s", None) + f""",
c AS (SELECT ytrue AS a, pred AS b, count(*) AS nab FROM pred_s GROUP BY ytrue, pred),
d AS (SELECT nab, sum(nab) OVER (PARTITION BY a) AS na, sum(nab) OVER (PARTITION BY b) AS nb, sum(nab) OVER () AS n FROM c),
r AS (SELECT sum(nab * 1.0e0 / n * ln(n * nab * 1.0e0 / (na * nb))) AS mi, -sum(nab * 1.0e0 / n * ln(na * 1.0e0 / n)) AS h_a,
             -sum(nab * 1.0e0 / n * ln(nb * 1.0e0 / n)) AS h_b FROM d)
SELECT round(mi, {R}) AS mi, round(h_a, {R}) AS h_a, round(h_b, {R}) AS h_b,
  round(CASE WHEN (h_a + h_b) / 2 = 0 THEN 1.0e0 ELSE mi / ((h_a + h_b) / 2) END, {R}) AS nmi FROM r""",
        "emb_contrastive": f"""WITH b AS (SELECT vec_id AS row_id, label AS y, CAST(embedding AS DOUBLE[]) AS e,
     CAST(floor(vec_id / 128) AS BIGINT) AS bucket FROM embeddings),
j AS (SELECT l.bucket, l.row_id, l.y AS ly, r.y AS ry,
        exp(list_sum(list_transform(list_zip(l.e, r.e), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(l.e, lambda x: x * x))) * sqrt(list_sum(list_transform(r.e, lambda x: x * x)))) / 0.5e0) AS e
      FROM b l JOIN b r ON l.bucket = r.bucket AND l.row_id <> r.row_id),
g AS (SELECT bucket, row_id, sum(CASE WHEN ly = ry THEN e END) AS pos, sum(e) AS al FROM j GROUP BY bucket, row_id)
SELECT row_id, bucket, round(-ln(pos / al), {R}) AS score FROM g WHERE pos IS NOT NULL""",
    }
