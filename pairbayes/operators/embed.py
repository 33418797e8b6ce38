"""Embedding and class analytics.

Per-feature statistics use the long form ``posexplode(x)`` -> group-by;
class-pair statistics self-join the (class x feature) summary table, whose
size is bounded by C*F, never the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.functions.columns import cosine, dot, l2_normalize
from pairbayes.operators.gram import component_scores, correlations, principal_components, wanted_pairs


def long_form(fx: DataFrame, keep=("row_id", "y"), x: str = "x") -> DataFrame:
    return fx.select(*keep, F.posexplode(x).alias("feature", "v")).withColumn("feature", F.col("feature").cast("int"))


def label_correlation(fx_y: DataFrame) -> DataFrame:
    """Pearson correlation of every feature with the label code."""
    lf = long_form(fx_y)
    return lf.groupBy("feature").agg(F.corr("v", F.col("y").cast("double")).alias("corr"))


def feature_correlation(fx: DataFrame, pairs=None, n_features: int | None = None) -> DataFrame:
    """(f1, f2, corr), the Pearson correlation of the given feature pairs (all, if none are given)."""
    from pairbayes.operators.features import n_features_of

    every = correlations(fx, n_features or n_features_of(fx))
    if pairs is not None:
        every = wanted_pairs(every, pairs, 0)
    return every.select(F.col("i").alias("f1"), F.col("j").alias("f2"), "corr")


def class_feature_stats(fx_y: DataFrame) -> DataFrame:
    """(y, feature, n, mean, var_pop): the C x F summary every class analytic uses."""
    lf = long_form(fx_y)
    return lf.groupBy("y", "feature").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var_pop")
    )


def class_separation(fx_y: DataFrame) -> DataFrame:
    """between/within variance ratio per feature, divided by the max.
    between = sum_c n_c (mu_c - mu)^2, within = sum_c n_c var_pop_c."""
    s = class_feature_stats(fx_y)
    w = Window.partitionBy("feature")
    mu = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    s = s.withColumn("mu", mu)
    g = s.groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("mu")) * (F.col("mean") - F.col("mu"))).alias("between"),
        F.sum(F.col("n") * F.col("var_pop")).alias("within"),
    )
    g = g.withColumn("score", F.when(F.col("within") > 0, F.col("between") / F.col("within")).otherwise(F.col("between")))
    mx = F.max("score").over(Window.partitionBy())
    return g.withColumn("score_norm", F.when(mx > 0, F.col("score") / mx).otherwise(F.col("score")))


def class_mean_cosine(fx_y: DataFrame, first_k: int | None = None) -> DataFrame:
    """Cosine similarity of class mean vectors for every class pair a<b, over
    all rows (or the first ``first_k`` of each class by id, where that is asked)."""
    src = fx_y
    if first_k is not None:
        w = Window.partitionBy("y").orderBy("row_id")
        src = fx_y.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= first_k)
    m = long_form(src).groupBy("y", "feature").agg(F.avg("v").alias("m"))
    a = m.select(F.col("y").alias("class_a"), "feature", F.col("m").alias("ma"))
    b = m.select(F.col("y").alias("class_b"), "feature", F.col("m").alias("mb"))
    j = a.join(b, "feature").where(F.col("class_a") < F.col("class_b"))
    g = j.groupBy("class_a", "class_b").agg(
        F.sum(F.col("ma") * F.col("mb")).alias("dot"), F.sum(F.col("ma") * F.col("ma")).alias("na"),
        F.sum(F.col("mb") * F.col("mb")).alias("nb"),
    )
    # a class whose mean is zero has cosine 0 with all
    return g.select("class_a", "class_b", F.coalesce(F.try_divide(F.col("dot"), F.sqrt("na") * F.sqrt("nb")), F.lit(0.0)).alias("cosine"))


def gaussian_kl(fx_y: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Rows L2-normalised; per class mean and population variance + eps;
    diagonal KL(i||j) for class pairs i<j (log terms add eps again, as the
    reference does); returns per-pair KL and, via ``avg``, the mean."""
    n = fx_y.select("row_id", "y", l2_normalize(F.col("x")).alias("x"))
    s = long_form(n).groupBy("y", "feature").agg(F.avg("v").alias("m"), (F.var_pop("v") + F.lit(eps)).alias("var"))
    a = s.select(F.col("y").alias("class_i"), "feature", F.col("m").alias("mi"), F.col("var").alias("vi"))
    b = s.select(F.col("y").alias("class_j"), "feature", F.col("m").alias("mj"), F.col("var").alias("vj"))
    j = a.join(b, "feature").where(F.col("class_i") < F.col("class_j"))
    term = (F.lit(0.5) * (F.ln(F.col("vj") + F.lit(eps)) - F.ln(F.col("vi") + F.lit(eps)))
            + F.lit(0.5) * (F.col("vi") + (F.col("mi") - F.col("mj")) * (F.col("mi") - F.col("mj"))) / (F.col("vj") + F.lit(eps))
            - F.lit(0.5))
    return j.groupBy("class_i", "class_j").agg(F.sum(term).alias("kl"))


def class_means_matrix(fx_y: DataFrame, n_classes: int, n_features: int) -> list[list[float]]:
    """C x F class means (bounded by the class count and the schema)."""
    rows = class_feature_stats(fx_y).select("y", "feature", "mean").collect()
    M = [[0.0] * n_features for _ in range(n_classes)]
    for r in rows:
        M[r["y"]][r["feature"]] = float(r["mean"] or 0.0)  # a class with only nulls in a feature
    return M


def reconstruct(scored: DataFrame, means: list[list[float]], post: str = "posterior") -> DataFrame:
    """B20 (re-aimed): x_hat = sum_c P(c) * mean_c(x), the expected feature
    vector under the posterior.  The C x F means are a plan literal."""
    C = len(means)
    Fn = len(means[0]) if C else 0
    M = F.lit(means)
    xhat = F.transform(
        F.sequence(F.lit(0), F.lit(Fn - 1)),
        lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(C - 1)), F.lit(0.0).cast("double"),
                              lambda acc, c: acc + F.col(post)[c] * M[c][i]),
    )
    return scored.withColumn("x_hat", xhat)


def reconstruction_errors(rec: DataFrame) -> DataFrame:
    """Per-row MSE between x and x_hat."""
    se = F.aggregate(F.zip_with("x", "x_hat", lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda s, v: s + v)
    return rec.withColumn("mse", F.try_divide(se, F.size("x")))  # null for an empty vector


def contrastive_scores(fx_y: DataFrame, batch_rows: int = 128, temperature: float = 0.5) -> DataFrame:
    """B23 per batch: a batch is ``batch_rows`` consecutive ids (the id column
    keys it, so unrelated rows never change a score); within a batch, score_i =
    -ln(sum_{same class, j!=i} e^{cos/t} / sum_{j!=i} e^{cos/t}) for rows with a
    same-class partner; a zero vector has cosine 0 with all.  The self-join is on
    the batch, so work is N*batch_rows, never N^2."""
    b = fx_y.select("row_id", "y", "x", F.floor(F.col("row_id") / batch_rows).cast("long").alias("bucket"))
    l = b.alias("l")
    r = b.alias("r")
    j = l.join(r, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.row_id") != F.col("r.row_id")))
    e = F.exp(cosine(F.col("l.x"), F.col("r.x")) / F.lit(temperature))
    g = j.groupBy(F.col("l.bucket").alias("bucket"), F.col("l.row_id").alias("row_id")).agg(
        F.sum(F.when(F.col("l.y") == F.col("r.y"), e)).alias("pos"), F.sum(e).alias("all")
    )
    return g.where(F.col("pos").isNotNull()).withColumn("score", -F.ln(F.col("pos") / F.col("all")))


def kmeans_clusters(fx: DataFrame, k: int, seed: int = 42, normalize: bool = True, n_init: int = 10):
    """Pyspark.ml KMeans (k-means||, seeded) on (optionally L2-normalised)
    vectors, the best of ``n_init`` starts by the sum of squared distances;
    returns the model and ``(row_id, cluster)``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from pyspark import StorageLevel

    v = fx.select("row_id", *(["y"] if "y" in fx.columns else []),
                  array_to_vector(l2_normalize(F.col("x")) if normalize else F.col("x")).alias("features"))
    # iterative: cache the vectors once, not re-derived per iteration
    v = v.persist(StorageLevel.MEMORY_AND_DISK)
    fits = [KMeans(k=k, seed=seed + i, maxIter=20, initSteps=2).fit(v) for i in range(n_init)]
    model = min(fits, key=lambda m: m.summary.trainingCost)  # the first of equal ones
    return model, model.transform(v).withColumnRenamed("prediction", "cluster").drop("features")


def soft_assignment(fx: DataFrame, centres: list[list[float]], tau: float = 1.0) -> DataFrame:
    """B22 soft part: q = softmax(cos(x, centre)/tau) with L2-normalised
    centres (plan literal, k x F); p = q^2 / sum_rows(q), row-normalised."""
    cn = []
    for c in centres:
        nrm = math.sqrt(sum(v * v for v in c)) or 1.0
        cn.append([v / nrm for v in c])
    K = len(cn)
    Cl = F.lit(cn)
    from pairbayes.functions.columns import dot, softmax

    # Each step is its own column so no expression is inlined several times.
    keep = ["row_id", *(["y"] if "y" in fx.columns else [])]
    q = fx.select(*keep, l2_normalize(F.col("x")).alias("xn"))
    q = q.select(*keep, F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda k: dot(F.col("xn"), Cl[k]) / F.lit(tau)).alias("sims"))
    from pairbayes.operators.posterior import posterior_columns

    q = posterior_columns(q.withColumnRenamed("sims", "ll"), 0.0).select(*keep, F.col("posterior").alias("q"))
    fk = q.agg(*[F.sum(F.col("q")[k]).alias(f"f{k}") for k in range(K)])
    f = fk.collect()[0]  # K scalars
    fl = F.lit([float(f[f"f{k}"]) for k in range(K)])
    p = F.transform(F.col("q"), lambda v, k: v * v / fl[k])
    tot = F.aggregate(p, F.lit(0.0).cast("double"), lambda a, v: a + v)
    return q.withColumn("p", F.transform(p, lambda v: v / tot))


# Fixed values of the soft assignment: freedom of the t law, and what keeps its quotients defined.
T_FREEDOM, SOFT_EPS = 1.0, 1e-8


def student_assignment(fx: DataFrame, centres: list[list[float]], alpha: float = T_FREEDOM) -> tuple[DataFrame, DataFrame]:
    """(rows, loss) of Student-t assignments to L2-normalised centres.

    rows: (row_id, q array, p array, cluster, confidence) with q ~ (1 + d^2/alpha)^(-(alpha+1)/2) by the chord
    d between unit vectors, and the target p ~ q^2 / (sum of q over all rows).  loss: one row ``kl``, the mean
    of sum p ln(p / (q + 1e-8)).  A zero vector has cosine 0 with every centre."""
    from pairbayes.functions.columns import argmax_first, array_sum

    lengths = [math.sqrt(sum(v * v for v in c)) or 1.0 for c in centres]
    told = F.lit([[v / n for v in c] for c, n in zip(centres, lengths)])
    k = range(len(centres))
    d = fx.select("row_id", l2_normalize(F.col("x")).alias("xn"))
    d = d.select("row_id", F.transform(told, lambda c: 2 * (1 - dot(F.col("xn"), c)) + SOFT_EPS).alias("d2"))
    d = d.select("row_id", F.transform("d2", lambda v: F.pow(1 + v / alpha, F.lit(-(alpha + 1) / 2))).alias("t"))
    q = d.select("row_id", "t", array_sum(F.col("t")).alias("s")).select("row_id", F.transform("t", lambda v: v / (F.col("s") + SOFT_EPS)).alias("q"))
    total = q.agg(*[F.sum(F.col("q")[i]).alias(f"f{i}") for i in k]).first()
    f = F.lit([float(total[f"f{i}"] or 0.0) + SOFT_EPS for i in k])
    p = q.select("row_id", "q", F.transform("q", lambda v, i: v * v / f[i]).alias("u"))
    p = p.select("row_id", "q", "u", array_sum(F.col("u")).alias("s")).select("row_id", "q", F.transform("u", lambda v: v / (F.col("s") + SOFT_EPS)).alias("p"))
    rows = p.select("row_id", "q", "p", argmax_first(F.col("q")).alias("cluster"), F.array_max("q").alias("confidence"))
    term = F.zip_with("p", "q", lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(b + SOFT_EPS))).otherwise(F.lit(0.0)))
    return rows, rows.agg(F.avg(F.aggregate(term, F.lit(0.0), lambda s, v: s + v)).alias("kl"))


def pca_scores(fx: DataFrame, k: int = 2, n_features: int | None = None) -> DataFrame:
    """(row_id, pc1.., ev1..): scores on the principal components of the standardised features,
    each scaled to [-1, 1], and the components' shares of the variance."""
    from pairbayes.operators.features import n_features_of

    model = principal_components(fx, n_features or n_features_of(fx), k)
    s = component_scores(fx, model)
    b = s.agg(*[f(F.col("pc")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = []
    for i in range(k):
        lo, hi = b[f"lo{i}"] or 0.0, b[f"hi{i}"] or 0.0
        scaled.append((F.lit(2.0) * (F.col("pc")[i] - F.lit(lo)) / F.lit((hi - lo) or 1.0) - F.lit(1.0)).alias(f"pc{i + 1}"))
    return s.select("row_id", *scaled, *[F.lit(float(v)).alias(f"ev{i + 1}") for i, v in enumerate(model.variance)])
