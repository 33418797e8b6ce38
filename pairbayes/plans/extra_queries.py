"""Further registered queries: masked posterior, train log, feature
selection, distributions, cardinality summaries, pixel extras, checks,
ordering, sampling, CSV round trip."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.functions.columns import row_standardize
from pairbayes.operators import pixels, prep, sampling, select
from pairbayes.operators.posterior import score
from pairbayes.plans.learner_queries import BOOST_BINS, EMB_DIMS, ROUND, _boost_fx, _boost_model, _emb, _emb_model
from pairbayes.plans.oracles import boost_base, emb_base, score_ctes, two_epoch_ctes
from pairbayes.plans.pixel_queries import PIX, pixel_table
from pairbayes.session import table

R = 6
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CARD = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def li_overlap_masked(spark, sf) -> DataFrame:
    """Posterior with cells shared by >= 2 classes zeroed."""
    model, fx_y = _boost_model(spark, sf)
    m = replace(model, overlap_mask=True, _table=None, _table_rows=None)
    s = score(m, fx_y, unique=True)
    return s.select("row_id", F.col("y").alias("true_class"), F.col("pred").alias("pred_class"),
                    F.round("confidence", ROUND).alias("confidence"))


def li_train_log(spark, sf) -> DataFrame:
    """Per-epoch errors and the running best of a 2-epoch run."""
    from pairbayes.plans.train import TrainLog, train

    model, fx_y = _boost_model(spark, sf)
    log = TrainLog()
    train(model, fx_y, epochs=2, patience=5, log=log)
    df = log.to_frame(spark)
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("epoch", "n_errors", F.min("n_errors").over(w).alias("best_errors"))


def emb_selected_features(spark, sf) -> DataFrame:
    """Selected feature indices of the 64-d embeddings."""
    fx_y, classes = _emb(spark, sf, 64)
    return select.select_features(fx_y, len(classes)).select("feature", F.round("score", R).alias("score"))


def emb_distribution(spark, sf) -> DataFrame:
    """Per class quantiles of every feature."""
    fx_y, _ = _emb(spark, sf, EMB_DIMS)
    d = select.distribution_data(fx_y, range(EMB_DIMS))
    return d.select("y", F.col("feature").cast("int").alias("feature"), "n",
                    *[F.round(c, R).alias(c) for c in ("q5", "q25", "q50", "q75", "q95")])


def li_cardinality_summary(spark, sf) -> DataFrame:
    """Distribution of distinct ratios over lineitem columns."""
    c = prep.cardinality(table(spark, sf, "lineitem"), LI_CARD)
    s = prep.cardinality_threshold_report(c)
    return s.select(*[F.round(x, R).alias(x) for x in s.columns])


def li_row_cardinality(spark, sf) -> DataFrame:
    """Per batch (order key mod 16) the sum over feature pairs of the
    distinct (f1, f2) value combinations."""
    li = table(spark, sf, "lineitem").select(F.pmod(F.col("l_orderkey"), F.lit(16)).alias("batch"), F.array(*[F.col(c).cast("double") for c in LI_NUM]).alias("x"))
    return prep.pair_cardinality(li, "batch", len(LI_NUM))


def px_dataset_stats(spark, sf):
    s = pixels.dataset_stats(pixel_table(spark, sf), ["v", "red", "green"])
    return s.select(*[F.round(c, R).alias(c) for c in s.columns])


def px_channel_stats(spark, sf):
    s = prep.channel_stats(pixel_table(spark, sf), ["v", "red", "green"])
    return s.select("channel", *[F.round(c, R).alias(c) for c in ("mean", "std", "min", "max")], "n")


def px_satellite(spark, sf):
    s = pixels.satellite_indices(pixel_table(spark, sf), "nir", "red", "green", "blue")
    return s.select("image_id", *[F.round(c, R).alias(c) for c in ("ndvi", "ndwi", "ndbi", "mndwi")])


def px_robust_contrast(spark, sf):
    s = pixels.robust_contrasts(pixel_table(spark, sf))
    return s.select("image_id", *[F.round(c, R).alias(c) for c in s.columns if c != "image_id"])


def px_tail_snr(spark, sf):
    s = pixels.tail_snr(pixel_table(spark, sf))
    return s.select("image_id", F.round("snr", 3).alias("snr"), F.round("cnr", 3).alias("cnr"))


def px_heterogeneity(spark, sf):
    """I22, over more than 20 bright pixels here (the images are small)."""
    s = pixels.bright_heterogeneity(pixel_table(spark, sf), least=20)
    return s.select("image_id", F.round("bright_heterogeneity", R).alias("bright_heterogeneity"),
                    F.round("histogram_entropy", R).alias("histogram_entropy"))


def px_scene_flags(spark, sf):
    return pixels.scene_flags(pixel_table(spark, sf), "v", "red", "green", "blue")


def px_normalised(spark, sf):
    """All four methods side by side."""
    out = pixel_table(spark, sf).select("image_id", "y", "x", "v")
    for m in ("percent", "minmax", "asinh", "zscale"):
        out = pixels.normalise_image(out, m).withColumn(m, F.round("norm", R)).drop("norm")
    return out.drop("v")


def px_local_texture(spark, sf):
    """I16: local contrast, noise, uniformity and urban texture."""
    s = pixels.local_texture(pixel_table(spark, sf))
    return s.select("image_id", *[F.round(c, R).alias(c) for c in s.columns if c != "image_id"])


def px_chlorophyll(spark, sf):
    """Green chlorophyll and chlorophyll indices."""
    s = pixels.chlorophyll(pixel_table(spark, sf), "nir", "red", "green")
    return s.select("image_id", *[F.round(c, 4).alias(c) for c in s.columns if c != "image_id"])


def li_normalise_roundtrip(spark, sf):
    """P10: normalise with frozen stats then denormalise: the original values."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", *LI_NUM)
    st = {r["column_name"]: (r["mean"], r["std"]) for r in prep.column_stats(li, LI_NUM).collect()}
    back = prep.denormalise(prep.normalise(li, LI_NUM, st), LI_NUM, {c: (m, s + 1e-8) for c, (m, s) in st.items()})
    return back.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", *[F.round(c, 4).alias(c) for c in LI_NUM])


def emb_row_standardize(spark, sf):
    """Each embedding standardised by its own mean and population std."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    s = e.select("vec_id", row_standardize(F.col("e")).alias("z"))
    return s.select("vec_id", *[F.round(F.col("z")[i], R).alias(f"z_{i}") for i in range(64)])


def doc_unknown_targets(spark, sf):
    """Quality labels outside the known classes (only 1 is known here)."""
    known = spark.range(1, 2).select(F.col("id").cast("string").alias("c"))
    return select.unknown_targets(table(spark, sf, "labels"), "quality", known)


def doc_labelled_semi(spark, sf):
    """Documents that have a label (semi join) and their language counts."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def px_feature_union(spark, sf):
    """domain_ and quality_ feature sets united by name; absent keys null."""
    b = pixels.basic_stats(pixel_table(spark, sf)).select("image_id", F.round("mean", R).alias("domain_mean"),
                                                         F.round("std", R).alias("domain_std"))
    a = pixels.astro_stats(pixel_table(spark, sf)).select("image_id", F.round("snr", 3).alias("quality_snr"))
    return b.unionByName(a, allowMissingColumns=True)


def emb_global_order(spark, sf):
    """Dense global index by vec_id (distributed sort + zipWithIndex)."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return sampling.global_index(e, ["vec_id"])


def emb_sample(spark, sf):
    """100 rows by a seeded hash order (the sample size is the feature)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    return sampling.seeded_sample(e, 100)


def li_method_comparison(spark, sf):
    """Both weight-update rules on the 4-d model (rows-only)."""
    model, fx_y = _boost_model(spark, sf)
    return select.compare_methods(fx_y, model, epochs=2, unique=True).select("method", "accuracy", "epochs")


def li_csv_roundtrip(spark, sf):
    """Lineitem columns written as ';'-separated CSV, separator
    sniffed, read back with an explicit schema; totals per return flag."""
    from pairbayes.sources import sinks
    from pairbayes.sources.model_store import scratch_path

    path = scratch_path(spark, "csv")
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    li.write.option("sep", ";").option("header", "true").csv(path)
    sep = sinks.sniff_separator(spark, path)
    back = sinks.read_csv_table(spark, path, sep=sep, header=True,
                                schema="l_returnflag string, l_quantity double, l_extendedprice double", target="l_returnflag")
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"),
                                            F.round(F.sum("l_extendedprice"), 2).alias("price"))


QUERIES = {
    "li_overlap_masked": li_overlap_masked,
    "li_train_log": li_train_log,
    "emb_selected_features": emb_selected_features,
    "emb_distribution": emb_distribution,
    "li_cardinality_summary": li_cardinality_summary,
    "li_row_cardinality": li_row_cardinality,
    "px_dataset_stats": px_dataset_stats,
    "px_channel_stats": px_channel_stats,
    "px_satellite": px_satellite,
    "px_robust_contrast": px_robust_contrast,
    "px_tail_snr": px_tail_snr,
    "px_heterogeneity": px_heterogeneity,
    "px_scene_flags": px_scene_flags,
    "px_normalised": px_normalised,
    "px_local_texture": px_local_texture,
    "px_chlorophyll": px_chlorophyll,
    "li_normalise_roundtrip": li_normalise_roundtrip,
    "emb_row_standardize": emb_row_standardize,
    "doc_unknown_targets": doc_unknown_targets,
    "doc_labelled_semi": doc_labelled_semi,
    "px_feature_union": px_feature_union,
    "emb_global_order": emb_global_order,
    "emb_sample": emb_sample,
    "li_method_comparison": li_method_comparison,
    "li_csv_roundtrip": li_csv_roundtrip,
}


def oracles() -> dict[str, str]:
    import itertools

    ov_score = "WITH " + boost_base() + """,
ov AS (SELECT pair_id, bi, bj FROM counts GROUP BY pair_id, bi, bj HAVING count(DISTINCT y) >= 2),
ll_s AS (SELECT r.row_id, r.y AS ytrue, c.y AS cls,
   sum(CASE WHEN o.pair_id IS NOT NULL THEN ln(1e-10)
            ELSE ln(((CAST(coalesce(k.n, 0) AS DOUBLE) + 1.0e0) / (CAST(c.nc AS DOUBLE) + 1024.0e0 + 1e-8)) * 1e-6 + 1e-10) END) AS ll
   FROM rowcells r CROSS JOIN ncls c
   LEFT JOIN counts k ON k.y = c.y AND k.pair_id = r.pair_id AND k.bi = r.bi AND k.bj = r.bj
   LEFT JOIN ov o ON o.pair_id = r.pair_id AND o.bi = r.bi AND o.bj = r.bj
   GROUP BY r.row_id, r.y, c.y),
ex AS (SELECT row_id, ytrue, cls, exp(ll - max(ll) OVER (PARTITION BY row_id)) AS e FROM ll_s),
po AS (SELECT row_id, ytrue, cls, e / (sum(e) OVER (PARTITION BY row_id) + 1e-10) AS p FROM ex),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, cls) AS rn FROM po)
SELECT row_id, ytrue AS true_class, cls AS pred_class, round(p, 6) AS confidence FROM rk WHERE rn = 1"""
    card = " UNION ALL ".join(f"SELECT count(DISTINCT {c}) * 1.0e0 / count(*) AS ratio FROM lineitem" for c in LI_CARD)
    rowcard = " UNION ALL ".join(
        f"SELECT l_orderkey % 16 AS batch, count(DISTINCT ({a}, {b})) AS d FROM lineitem GROUP BY 1" for a, b in itertools.combinations(LI_NUM, 2))
    q = lambda p: f"quantile_cont(v, {p})"
    return {
        "li_overlap_masked": ov_score,
        "li_train_log": "WITH " + two_epoch_ctes() + """,
lg AS (SELECT 0 AS epoch, (SELECT count(*) FROM pred_e0 WHERE pred <> ytrue) AS n_errors
       UNION ALL SELECT 1, (SELECT count(*) FROM pred_e1 WHERE pred <> ytrue))
SELECT CAST(epoch AS INTEGER) AS epoch, n_errors, min(n_errors) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_errors FROM lg""",
        "emb_distribution": f"""WITH lf AS (SELECT label AS y, CAST(t.i - 1 AS INTEGER) AS feature, CAST(embedding[t.i] AS DOUBLE) AS v FROM embeddings CROSS JOIN range(1, 65) t(i))
SELECT y, feature, count(*) AS n, {", ".join(f"round({q(p / 100)}, {R}) AS q{p}" for p in (5, 25, 50, 75, 95))} FROM lf GROUP BY y, feature""",
        "li_cardinality_summary": f"""WITH c AS ({card})
SELECT round(min(ratio), {R}) AS min_ratio, round(max(ratio), {R}) AS max_ratio, round(avg(ratio), {R}) AS mean_ratio,
  round(quantile_cont(ratio, 0.5), {R}) AS median_ratio, round(quantile_cont(ratio, 0.9), {R}) AS p90_ratio,
  round(avg(CASE WHEN ratio <= 0.9 THEN 1.0e0 ELSE 0.0e0 END), {R}) AS share_below FROM c""",
        "li_row_cardinality": f"WITH u AS ({rowcard}) SELECT batch, CAST(sum(d) AS BIGINT) AS cardinality FROM u GROUP BY batch",
        "px_dataset_stats": f"""WITH {PIX}, per AS (SELECT image_id, avg(v) AS mv, avg(red) AS mr, avg(green) AS mg, stddev_pop(v) AS sv, stddev_pop(red) AS sr, stddev_pop(green) AS sg FROM pix GROUP BY image_id)
SELECT round(avg(mv), {R}) AS mean_v, round(avg(mr), {R}) AS mean_red, round(avg(mg), {R}) AS mean_green,
  round(avg(sv), {R}) AS std_v, round(avg(sr), {R}) AS std_red, round(avg(sg), {R}) AS std_green FROM per""",
        "px_channel_stats": f"""WITH {PIX} """ + " UNION ALL ".join(
            f"SELECT '{c}' AS channel, round(avg({c}), {R}) AS mean, round(stddev_samp({c}), {R}) AS std, round(min({c}), {R}) AS min, round(max({c}), {R}) AS max, count({c}) AS n FROM pix"
            for c in ("v", "red", "green")),
        "px_satellite": f"""WITH {PIX} SELECT image_id, round(avg((nir - red) / (nir + red + 1e-8)), {R}) AS ndvi,
  round(avg((green - nir) / (green + nir + 1e-8)), {R}) AS ndwi, round(avg((blue - nir) / (blue + nir + 1e-8)), {R}) AS ndbi,
  round(avg((green - blue) / (green + blue + 1e-8)), {R}) AS mndwi FROM pix GROUP BY image_id""",
        "px_robust_contrast": f"""WITH {PIX}, g AS (SELECT image_id, {q(0.05)} AS p5, {q(0.95)} AS p95, {q(0.01)} AS p1, {q(0.99)} AS p99,
  stddev_pop(v) AS sd, avg(v) AS mean, max(v) - min(v) AS dr, avg(CASE WHEN v > 0.95 THEN 1.0e0 ELSE 0.0e0 END) AS bs,
  avg(CASE WHEN v < 0.2 THEN 1.0e0 ELSE 0.0e0 END) AS ds FROM pix GROUP BY image_id)
SELECT image_id, round((p95 - p5) / (p95 + p5 + 1e-8), {R}) AS robust_contrast, round((p99 - p1) / (p99 + p1 + 1e-8), {R}) AS michelson,
  round(sd, {R}) AS rms_contrast, round(dr, {R}) AS dynamic_range, round(bs, {R}) AS bright_share, round(ds, {R}) AS dark_share,
  round(1.0e0 - sd / (mean + 1e-8), {R}) AS uniformity FROM g""",
        "px_tail_snr": f"""WITH {PIX}, q AS (SELECT image_id, {q(0.9)} AS p90, {q(0.1)} AS p10, {q(0.95)} AS p95, {q(0.05)} AS p5, avg(v) AS am, stddev_pop(v) AS asd FROM pix GROUP BY image_id),
g AS (SELECT p.image_id, coalesce(avg(CASE WHEN v > p90 THEN v END), any_value(am)) AS sig,
  coalesce(stddev_pop(CASE WHEN v < p10 THEN v END), any_value(asd)) AS noise, any_value(p95 - p5) AS con FROM pix p JOIN q ON q.image_id = p.image_id GROUP BY p.image_id)
SELECT image_id, round(sig / (noise + 1e-8), 3) AS snr, round(con / (noise + 1e-8), 3) AS cnr FROM g""",
        "px_heterogeneity": f"""WITH {PIX}, q AS (SELECT image_id, {q(0.85)} AS p85 FROM pix GROUP BY image_id),
b AS (SELECT p.image_id, p.v FROM pix p JOIN q ON q.image_id = p.image_id WHERE p.v > p85),
het AS (SELECT image_id, stddev_pop(v) / (avg(v) + 1e-8) AS h, count(*) AS n, CASE WHEN min(v) = max(v) THEN min(v) - 0.5e0 ELSE min(v) END AS lo,
  CASE WHEN min(v) = max(v) THEN max(v) + 0.5e0 ELSE max(v) END AS hi FROM b GROUP BY image_id),
hk AS (SELECT b.image_id, CAST(least(19, floor((v - lo) / ((hi - lo) / 20.0e0))) AS INTEGER) AS k, count(*) * 1.0e0 / any_value(n * ((hi - lo) / 20.0e0)) AS d
  FROM b JOIN het ON het.image_id = b.image_id WHERE n > 20 GROUP BY 1, 2),
ent AS (SELECT image_id, -sum(d * ln(d + 1e-10)) AS e FROM hk GROUP BY image_id)
SELECT q.image_id, round(coalesce(het.h, 0.0e0), {R}) AS bright_heterogeneity, round(coalesce(ent.e, 0.0e0), {R}) AS histogram_entropy
FROM q LEFT JOIN het ON het.image_id = q.image_id LEFT JOIN ent ON ent.image_id = q.image_id""",
        "px_scene_flags": f"""WITH {PIX}, g AS (SELECT image_id, avg(v) AS m, avg(red) AS r, avg(green) AS g, avg(blue) AS b FROM pix GROUP BY image_id)
SELECT image_id, m < 0.3 AS is_night, (b / (r + g + b + 1e-8) > 0.35) OR (g / (r + g + b + 1e-8) > 0.4) AS is_outdoor FROM g""",
        "px_normalised": f"""WITH {PIX}, s AS (SELECT image_id, {q(0.01)} AS p1, {q(0.99)} AS p99, {q(0.5)} AS med, min(v) AS lo, max(v) AS hi,
  list_sort(list(v)) AS vs FROM pix GROUP BY image_id),
z AS (SELECT *, vs[CAST(floor(len(vs) / 2) AS INTEGER) + 1] AS mid, 0.25e0 * (hi - lo) AS half FROM s)
SELECT p.image_id, p.y, p.x, round(least(1.0e0, greatest(0.0e0, (v - p1) / (p99 - p1 + 1e-8))), {R}) AS percent,
  round(least(1.0e0, greatest(0.0e0, (v - lo) / (hi - lo + 1e-8))), {R}) AS minmax,
  round(least(1.0e0, greatest(0.0e0, (asinh(v - med) - asinh(lo - med)) / (asinh(hi - med) - asinh(lo - med) + 1e-8))), {R}) AS asinh,
  round(least(1.0e0, greatest(0.0e0, (v - (mid - half)) / (mid + half - (mid - half) + 1e-8))), {R}) AS zscale FROM pix p JOIN z ON z.image_id = p.image_id""",
        "px_local_texture": f"""WITH {PIX}, """ + ", ".join(f"""
r{s} AS (SELECT image_id, y, x, v, sum(v) OVER w AS s1, sum(v * v) OVER w AS s2, count(v) OVER w AS n FROM pix
  WINDOW w AS (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN {s // 2} PRECEDING AND {s // 2} FOLLOWING)),
q{s} AS (SELECT image_id, v, sum(s1) OVER w / sum(n) OVER w AS lm, sum(s2) OVER w / sum(n) OVER w AS lq FROM r{s}
  WINDOW w AS (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN {s // 2} PRECEDING AND {s // 2} FOLLOWING)),
m{s} AS MATERIALIZED (SELECT image_id, v, lm, greatest(0.0e0, lq - lm * lm) AS lv FROM q{s})""" for s in (11, 5, 21)) + f""",
p AS (SELECT image_id, quantile_cont(lv, 0.9) AS p90, stddev_pop(v - lm) AS lc FROM m11 GROUP BY image_id),
u AS (SELECT m11.image_id, avg(lv) AS ut FROM m11 JOIN p ON p.image_id = m11.image_id WHERE lv > p90 GROUP BY m11.image_id),
n AS (SELECT image_id, stddev_pop(v - lm) AS nl FROM m5 GROUP BY image_id),
i AS (SELECT image_id, 1.0e0 - stddev_pop(lm) / (avg(lm) + 1e-8) AS iu, 1.0e0 - stddev_pop(sqrt(lv)) / (avg(sqrt(lv)) + 1e-8) AS tu FROM m21 GROUP BY image_id)
SELECT p.image_id, round(lc, {R}) AS local_contrast, round(nl, {R}) AS noise_level, round(iu, {R}) AS intensity_uniformity, round(tu, {R}) AS texture_uniformity,
  round(ut, {R}) AS urban_texture, round((iu + tu) / 2, {R}) AS overall_uniformity
FROM p JOIN n ON n.image_id = p.image_id JOIN i ON i.image_id = p.image_id LEFT JOIN u ON u.image_id = p.image_id""",
        "px_chlorophyll": f"""WITH {PIX}, c AS (SELECT image_id, green, CASE WHEN green <> 0 THEN nir / green - 1.0e0 END AS gci, green / (red + 1e-8) AS si,
  (green - red) / (green + red + 1e-8) AS nd, CASE WHEN green + red <> 0 THEN (green - red) / (green + red) * 100 END AS cci FROM pix)
SELECT image_id, round(avg(gci), 4) AS gci_mean, round(avg(CASE WHEN gci IS NOT NULL THEN greatest(0.0e0, least(10.0e0, gci)) END), 4) AS chlorophyll_estimate,
  round(avg(si), 4) AS chlorophyll_index, round(avg(nd), 4) AS chlorophyll_ndvi, round(avg(cci), 4) AS cci_estimate,
  round(avg(CASE WHEN green > 0.3 THEN 1.0e0 ELSE 0.0e0 END), 4) AS green_percentage, round(stddev_pop(si), 4) AS chlorophyll_variability FROM c GROUP BY image_id""",
        "li_normalise_roundtrip": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(l_quantity, 4) AS l_quantity,
  round(l_extendedprice, 4) AS l_extendedprice, round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax FROM lineitem""",
        "emb_row_standardize": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT vec_id, e, list_sum(e) / len(e) AS m FROM e),
t AS (SELECT vec_id, e, m, sqrt(list_sum(list_transform(e, lambda v: (v - m) * (v - m))) / len(e)) AS sd FROM s)
SELECT vec_id, {", ".join(f"round((e[{i + 1}] - m) / (sd + 1e-8), {R}) AS z_{i}" for i in range(64))} FROM t""",
        "doc_unknown_targets": "SELECT DISTINCT CAST(quality AS VARCHAR) AS label FROM labels WHERE CAST(quality AS VARCHAR) NOT IN ('1')",
        "doc_labelled_semi": "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang",
        "px_feature_union": f"""WITH {PIX}, q AS (SELECT image_id, quantile_cont(v, 0.1) AS background, quantile_cont(v, 0.2) AS p20, max(v) AS peak FROM pix GROUP BY image_id),
n AS (SELECT p.image_id, coalesce(stddev_pop(CASE WHEN v < q.p20 THEN v END), 0.0e0) AS noise FROM pix p JOIN q ON q.image_id = p.image_id GROUP BY p.image_id)
SELECT image_id, round(avg(v), {R}) AS domain_mean, round(stddev_pop(v), {R}) AS domain_std, CAST(NULL AS DOUBLE) AS quality_snr FROM pix GROUP BY image_id
UNION ALL SELECT q.image_id, NULL, NULL, round((peak - background) / (noise + 1e-8), 3) FROM q JOIN n ON n.image_id = q.image_id""",
        "emb_global_order": "SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS index FROM embeddings",
        "li_csv_roundtrip": """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_returnflag""",
    }


LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def li_fit_predict(spark, sf):
    """B12/B13 at table scale: lineitem measures -> return flag, B=32; rows
    numbered by the unique key (W11), split 80/20 by a seeded hash (W10);
    likelihood and bins from the training rows, one boosting epoch on them; every row scored; accuracy,
    mean confidence (A29) and mean class accuracy per split."""
    from pairbayes.operators.sampling import global_index, train_test_split
    from pairbayes.plans.predict import evaluation_by_split, fit_predict

    li = table(spark, sf, "lineitem").select(*LI_KEYS, F.col("l_returnflag").alias("label"),
                                             F.array(*[F.col(c).cast("double") for c in LI_NUM]).alias("x"))
    fx = train_test_split(global_index(li, LI_KEYS, "row_id"), "row_id", 0.2, 42)
    _, scored = fit_predict(fx, len(LI_NUM), n_bins=32, epochs=1)
    ev = evaluation_by_split(scored)
    return ev.select("split", "n", *[F.round(c, R).alias(c) for c in ("accuracy", "mean_confidence", "mean_class_accuracy")])


QUERIES["li_fit_predict"] = li_fit_predict

_extra_oracles_base = oracles


def oracles() -> dict[str, str]:  # noqa: F811
    from pairbayes.operators.sampling import split_unit_sql
    from pairbayes.plans.oracles import boost_ctes, hist_base

    o = _extra_oracles_base()
    src = ("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS row_id, "
           "l_returnflag AS label, [l_quantity, l_extendedprice, l_discount, l_tax] AS e FROM lineitem")
    train = f"{split_unit_sql('row_id')} < 0.8e0"
    base = hist_base(src, 4, 32, fit_filter=train)
    sc = score_ctes("e0", None, B=32) + f", pred_tr AS (SELECT * FROM pred_e0 WHERE {train})," + boost_ctes("e0", None, "pred_tr", "0.05e0", 32) + "," + score_ctes("s", "w_e0", B=32)
    o["li_fit_predict"] = "WITH " + base + "," + sc + f""",
sp AS (SELECT row_id, CASE WHEN {split_unit_sql('row_id')} < 0.8e0 THEN 'train' ELSE 'test' END AS split FROM src),
j AS (SELECT p.*, sp.split, CASE WHEN p.pred = p.ytrue THEN 1.0e0 ELSE 0.0e0 END AS ok FROM pred_s p JOIN sp ON sp.row_id = p.row_id),
pc AS (SELECT split, ytrue, avg(ok) AS acc_c FROM j GROUP BY split, ytrue),
mca AS (SELECT split, avg(acc_c) AS mca FROM pc GROUP BY split)
SELECT j.split, count(*) AS n, round(avg(ok), {R}) AS accuracy, round(avg(pmax), {R}) AS mean_confidence,
  round(any_value(mca.mca), {R}) AS mean_class_accuracy FROM j JOIN mca ON mca.split = j.split GROUP BY j.split"""
    return o


def li_overlap_rule_weights(spark, sf):
    """One boosting epoch with the bin-overlap rule (update only cells
    the predicted class does not occupy); 1024 bins, so that such cells exist."""
    from pairbayes.operators.binning import fit_bins
    from pairbayes.operators.encode import class_list, encode_labels
    from pairbayes.operators.likelihood import fit_histogram
    from pairbayes.plans.train import TrainLog, train

    fx = _boost_fx(spark, sf)
    classes = class_list(fx)
    fx_y = encode_labels(fx, classes)
    model = fit_histogram(fx_y, fit_bins(fx_y, 4, OVERLAP_BINS), classes, None, 4)
    m = train(model, fx_y, epochs=1, patience=5, rule="bin_overlap", log=TrainLog())
    return m.weights.select("y", "pair_id", "bi", "bj", F.round("w", 9).alias("w"))


OVERLAP_BINS = 1024


def li_predict_new(spark, sf):
    """The fitted model on rows without labels: decoded class, confidence and
    one ``prob_<class>`` column a class, for every row."""
    from pairbayes.plans.predict import predict_new

    model, _ = _boost_model(spark, sf)
    p = predict_new(model, _boost_fx(spark, sf).select("row_id", "x"))
    return p.select("row_id", "predicted_class", *[F.round(c, R).alias(c) for c in ("prediction_confidence", *[f"prob_{c}" for c in model.classes])])


def li_split_reload(spark, sf):
    """A split saved by id, reloaded and attached by id; rows and total quantity."""
    from pairbayes.operators.sampling import train_test_split
    from pairbayes.sources.model_store import scratch_path
    from pairbayes.sources.sinks import attach_split, write_split

    fx = _boost_fx(spark, sf)
    path = scratch_path(spark, "split")
    write_split(train_test_split(fx.select("row_id"), "row_id", 0.2, 42), path)
    back = attach_split(spark, fx, path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x")[0]), 2).alias("quantity"))


def li_smoothed_weights(spark, sf):
    """B17 (re-aimed): weights after one epoch, smoothed 0.7/0.3 with the
    average over pairs sharing a feature (same class and cell)."""
    from pairbayes.operators.boost import smooth_weights
    from pairbayes.plans.train import TrainLog, train

    model, fx_y = _boost_model(spark, sf)
    m = train(model, fx_y, epochs=1, patience=5, log=TrainLog())
    return smooth_weights(m).select("y", "pair_id", "bi", "bj", F.round("w", 9).alias("w"))


def doc_numeric_columns(spark, sf):
    """Text columns become numbers only when every value parses."""
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("string").alias("nc_text"), "lang")
    return prep.numeric_if_possible(d, ["nc_text", "lang"])


def emb_epoch_snapshots(spark, sf):
    """Per-epoch (row_id, split) snapshots appended, partitioned by
    epoch, read back; rows per epoch and split."""
    from pairbayes.operators.sampling import train_test_split
    from pairbayes.sources.model_store import scratch_path
    from pairbayes.sources.sinks import append_epoch_snapshot

    path = scratch_path(spark, "epochs")
    sp = train_test_split(table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id")), "row_id", 0.2, 42)
    for ep in range(3):
        append_epoch_snapshot(sp, path, ep)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("epoch").cast("int").alias("epoch"), "split").agg(F.count(F.lit(1)).alias("n"))


QUERIES.update({
    "li_overlap_rule_weights": li_overlap_rule_weights,
    "li_predict_new": li_predict_new,
    "li_split_reload": li_split_reload,
    "li_smoothed_weights": li_smoothed_weights,
    "doc_numeric_columns": doc_numeric_columns,
    "emb_epoch_snapshots": emb_epoch_snapshots,
})

_extra_oracles_base2 = oracles


def oracles() -> dict[str, str]:  # noqa: F811
    from pairbayes.operators.sampling import split_unit_sql
    from pairbayes.plans.oracles import boost_ctes

    o = _extra_oracles_base2()
    one = "WITH " + boost_base() + "," + score_ctes("e0", None, BOOST_BINS) + "," + boost_ctes("e0", None, "pred_e0", "0.05e0", BOOST_BINS)
    from pairbayes.plans.oracles import LI_SRC, hist_base

    fine = ("WITH " + hist_base(LI_SRC, 4, OVERLAP_BINS) + "," + score_ctes("e0", None, OVERLAP_BINS) + ","
            + boost_ctes("e0", None, "pred_e0", "0.05e0", OVERLAP_BINS))
    overlap = fine.replace(f"WHERE ((CAST(coalesce(k.n, 0) AS DOUBLE) + 1.0e0) / (CAST(c.nc AS DOUBLE) + CAST({OVERLAP_BINS ** 2} AS DOUBLE) + 1e-8)) < 0.25e0",
                           "WHERE k.n IS NULL")
    assert overlap != fine
    o["li_overlap_rule_weights"] = overlap + " SELECT y, pair_id, bi, bj, round(w, 9) AS w FROM w_e0"
    o["li_predict_new"] = "WITH " + boost_base() + "," + score_ctes("s", None, BOOST_BINS) + f""",
pr AS (SELECT p.row_id, max(p.p) AS top, {", ".join(f"max(CASE WHEN c.label = '{c}' THEN p.p END) AS p_{c}" for c in "ANR")}
       FROM post_s p JOIN cls c ON c.y = p.cls GROUP BY p.row_id)
SELECT pr.row_id, c.label AS predicted_class, round(top, {R}) AS prediction_confidence, {", ".join(f"round(p_{c}, {R}) AS prob_{c}" for c in "ANR")}
FROM pr JOIN pred_s s ON s.row_id = pr.row_id JOIN cls c ON c.y = s.pred"""
    o["li_split_reload"] = f"""WITH src AS ({LI_SRC})
SELECT CASE WHEN {split_unit_sql('row_id')} < 0.8e0 THEN 'train' ELSE 'test' END AS split, count(*) AS n, round(sum(e[1]), 2) AS quantity FROM src GROUP BY 1"""
    o["li_smoothed_weights"] = one + """,
lp AS (SELECT pair_id, f1 AS f FROM pairs UNION ALL SELECT pair_id, f2 FROM pairs),
adj AS (SELECT DISTINCT l.pair_id AS a, r.pair_id AS b FROM lp l JOIN lp r ON l.f = r.f AND l.pair_id < r.pair_id),
nb AS (SELECT a AS pair_id, b AS nb FROM adj UNION ALL SELECT b, a FROM adj),
deg AS (SELECT pair_id, count(*) AS deg FROM nb GROUP BY pair_id),
s AS (SELECT w.y, w.pair_id, w.bi, w.bj, sum(coalesce(w2.w, 1e-6)) AS s FROM w_e0 w JOIN nb ON nb.pair_id = w.pair_id
      LEFT JOIN w_e0 w2 ON w2.y = w.y AND w2.pair_id = nb.nb AND w2.bi = w.bi AND w2.bj = w.bj GROUP BY w.y, w.pair_id, w.bi, w.bj)
SELECT w.y, w.pair_id, w.bi, w.bj,
  round(0.7e0 * w.w + (1.0e0 - 0.7e0) * CASE WHEN d.deg > 0 THEN s.s / d.deg ELSE w.w END, 9) AS w
FROM w_e0 w LEFT JOIN s ON s.y = w.y AND s.pair_id = w.pair_id AND s.bi = w.bi AND s.bj = w.bj LEFT JOIN deg d ON d.pair_id = w.pair_id"""
    o["emb_selected_features"] = f"""WITH RECURSIVE lf AS (SELECT vec_id, label AS y, CAST(t.i - 1 AS INTEGER) AS f, CAST(embedding[t.i] AS DOUBLE) AS v
  FROM embeddings CROSS JOIN range(1, 65) t(i)),
sc AS (SELECT f, coalesce(corr(v, CAST(y AS DOUBLE)), 0.0e0) AS s FROM lf GROUP BY f),
n AS (SELECT count(*) AS strong FROM sc WHERE s >= 0.85e0),
cand AS (SELECT f, s, row_number() OVER (ORDER BY f) AS k FROM (SELECT f, s, row_number() OVER (ORDER BY s DESC, f) AS rn FROM sc)
  WHERE CASE WHEN (SELECT strong FROM n) >= 8 THEN s >= 0.85e0 ELSE rn <= 8 END),
bl AS (SELECT b.k, list(a.k) AS blk FROM cand a JOIN cand b ON a.k < b.k AND b.s <= a.s
  WHERE (SELECT corr(x.v, z.v) FROM lf x JOIN lf z ON z.vec_id = x.vec_id WHERE x.f = a.f AND z.f = b.f) > 0.01e0 GROUP BY b.k),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept
  UNION ALL SELECT w.k + 1, CASE WHEN len(list_intersect(coalesce((SELECT blk FROM bl WHERE bl.k = w.k + 1), CAST([] AS BIGINT[])), w.kept)) = 0 THEN list_append(w.kept, w.k + 1) ELSE w.kept END
  FROM walk w WHERE w.k < (SELECT count(*) FROM cand))
SELECT c.f AS feature, round(c.s, {R}) AS score FROM cand c, (SELECT kept FROM walk ORDER BY k DESC LIMIT 1) w WHERE list_contains(w.kept, c.k)"""
    o["emb_sample"] = f"SELECT vec_id AS row_id, label FROM embeddings ORDER BY {split_unit_sql('vec_id', 42)}, vec_id LIMIT 100"
    o["doc_numeric_columns"] = "SELECT doc_id, CAST(n_chars AS DOUBLE) AS nc_text, lang FROM documents"
    o["emb_epoch_snapshots"] = f"""SELECT CAST(t.e AS INTEGER) AS epoch, CASE WHEN {split_unit_sql('vec_id')} < 0.8e0 THEN 'train' ELSE 'test' END AS split, count(*) AS n
FROM embeddings CROSS JOIN range(0, 3) t(e) GROUP BY 1, 2"""
    return o


def px_image_quality(spark, sf):
    """Composite image qualities from focus, tail SNR and contrast."""
    s = pixels.image_quality(pixel_table(spark, sf))
    return s.select("image_id", "passed", F.round("image_quality", R).alias("image_quality"), F.round("diagnostic", 3).alias("diagnostic"),
                    F.round("scene", R).alias("scene"), F.round("surveillance", R).alias("surveillance"))


QUERIES["px_image_quality"] = px_image_quality

_extra_oracles_base3 = oracles


def oracles() -> dict[str, str]:  # noqa: F811
    o = _extra_oracles_base3()
    from pairbayes.plans.pixel_queries import oracles as pix_oracles

    po = pix_oracles()
    lap = po["px_laplacian"].replace(f", {R})", ", 12)")
    snr = o["px_tail_snr"].replace(", 3)", ", 12)")
    con = o["px_robust_contrast"].replace(f", {R})", ", 12)")
    o["px_image_quality"] = f"""WITH c AS ({con}), s AS ({snr}), f AS ({lap}), m AS (WITH {PIX} SELECT image_id, avg(v) AS mean FROM pix GROUP BY image_id),
j AS (SELECT c.*, s.snr, s.cnr, m.mean, f.focus_score, least(1.0e0, f.laplacian_variance / 1000.0e0 / 500.0e0) AS sharp,
        0.5e0 * f.focus_score + 0.3e0 * least(1.0e0, s.snr / 10.0e0) + 0.2e0 * c.robust_contrast AS q
      FROM c JOIN s ON s.image_id = c.image_id JOIN f ON f.image_id = c.image_id JOIN m ON m.image_id = c.image_id)
SELECT image_id, round(q, {R}) AS image_quality, CASE WHEN q > 0.5 THEN 1.0e0 ELSE 0.0e0 END AS passed,
  round((snr / 10.0e0 + cnr / 20.0e0 + sharp) / 3.0e0, 3) AS diagnostic, round((uniformity + (1.0e0 - dark_share) + sharp) / 3.0e0, {R}) AS scene,
  round(mean * 0.3e0 + rms_contrast * 0.3e0 + sharp * 0.4e0, {R}) AS surveillance FROM j"""
    return o


def px_dominant_cover(spark, sf):
    """Dominant land-cover class per image (ties -> first listed) and
    pass when its share exceeds 0.5."""
    lc = pixels.land_cover(pixel_table(spark, sf), "nir", "red", "green", "blue")
    cols = ["vegetation_cover", "water_cover", "urban_cover", "barren_cover"]
    return pixels.dominant(lc, cols, "dominant", 0.5).select("image_id", "dominant", "passed")


QUERIES["px_dominant_cover"] = px_dominant_cover

_extra_oracles_base4 = oracles


def oracles() -> dict[str, str]:  # noqa: F811
    from pairbayes.plans.pixel_queries import oracles as pix_oracles

    o = _extra_oracles_base4()
    lc = pix_oracles()["px_land_cover"].replace(f", {R})", ", 12)")
    top = "greatest(vegetation_cover, water_cover, urban_cover, barren_cover)"
    o["px_dominant_cover"] = f"""WITH lc AS ({lc})
SELECT image_id, CASE WHEN vegetation_cover = {top} THEN 'vegetation_cover' WHEN water_cover = {top} THEN 'water_cover'
  WHEN urban_cover = {top} THEN 'urban_cover' WHEN barren_cover = {top} THEN 'barren_cover' END AS dominant,
  {top} > 0.5 AS passed FROM lc"""
    return o


def li_configured_columns(spark, sf):
    """S2 + S3 + P27: configured columns (a '#' name excluded) checked
    against the file, the target resolved, required features put first in
    training order."""
    from pairbayes.sources.sinks import check_columns, select_configured

    li = table(spark, sf, "lineitem")
    cfg = ["l_quantity", "#l_tax", "l_discount", "l_returnflag"]
    target = check_columns(li, cfg, "l_returnflag")
    sel = select_configured(li, cfg)
    return select.require_features(sel, ["l_discount", "l_quantity"]).select("l_discount", "l_quantity", target)


QUERIES["li_configured_columns"] = li_configured_columns

_extra_oracles_base5 = oracles


def oracles() -> dict[str, str]:  # noqa: F811
    o = _extra_oracles_base5()
    o["li_configured_columns"] = "SELECT l_discount, l_quantity, l_returnflag FROM lineitem"
    return o
