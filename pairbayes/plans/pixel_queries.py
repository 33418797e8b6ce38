"""Registered pixel-statistics queries on a pixel table derived from lineitem.

image = supplier, row y = line number - 1, column x = position of the line
within (supplier, line number) ordered by (order, part, ship date) -- a key
that is unique; gray value = quantity / 50; bands: nir = quantity / 50,
red = discount * 10, green = tax * 10, blue = discount * 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.operators import pixels
from pairbayes.session import table

R = 6


def pixel_table(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_shipdate")
    return li.select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_linenumber") - 1).alias("y"),
        (F.row_number().over(w) - 1).cast("int").alias("x"),
        (F.col("l_quantity") / 50.0).alias("v"), (F.col("l_quantity") / 50.0).alias("nir"),
        (F.col("l_discount") * 10.0).alias("red"), (F.col("l_tax") * 10.0).alias("green"),
        (F.col("l_discount") * 5.0).alias("blue"))


def _r(df, cols):
    return df.select("image_id", *[F.round(c, R).alias(c) for c in cols])


def px_basic_stats(spark, sf):
    s = pixels.basic_stats(pixel_table(spark, sf))
    return _r(s, ["mean", "median", "std", "skew", "kurtosis", "p1", "p5", "p95", "p99", "value_range"])


def px_astro_stats(spark, sf):
    return _r(pixels.astro_stats(pixel_table(spark, sf)), ["background", "noise", "signal", "snr", "dynamic_range"])


def px_shape_stats(spark, sf):
    return _r(pixels.shape_stats(pixel_table(spark, sf)), ["xc", "yc", "ellipticity", "fwhm", "concentration", "position_angle"])


def px_asymmetry(spark, sf):
    return _r(pixels.asymmetry(pixel_table(spark, sf)), ["asymmetry"])


def px_vegetation(spark, sf):
    s = pixels.vegetation_indices(pixel_table(spark, sf), "nir", "red", "green", "blue")
    return _r(s, [c for c in s.columns if c != "image_id"])


def px_focus(spark, sf):
    return _r(pixels.focus_stats(pixel_table(spark, sf)), ["gradient_focus", "motion"])


def px_laplacian(spark, sf):
    s = pixels.laplacian_stats(pixel_table(spark, sf))
    return s.select("image_id", F.round("laplacian_variance", R).alias("laplacian_variance"), "n_pixels",
                    F.round("focus_score", R).alias("focus_score"), "is_out_of_focus")


def px_box_mean(spark, sf):
    s = pixels.box_mean(pixel_table(spark, sf), 1)
    return s.select("image_id", "y", "x", F.round("box_mean", R).alias("box_mean"))


QUERIES = {
    "px_basic_stats": px_basic_stats,
    "px_astro_stats": px_astro_stats,
    "px_shape_stats": px_shape_stats,
    "px_asymmetry": px_asymmetry,
    "px_vegetation": px_vegetation,
    "px_focus": px_focus,
    "px_laplacian": px_laplacian,
    "px_box_mean": px_box_mean,
}

PIX = """pix AS (SELECT l_suppkey AS image_id, l_linenumber - 1 AS y,
  CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_shipdate) - 1 AS INTEGER) AS x,
  l_quantity / 50.0e0 AS v, l_quantity / 50.0e0 AS nir, l_discount * 10.0e0 AS red, l_tax * 10.0e0 AS green, l_discount * 5.0e0 AS blue
  FROM lineitem)"""


def around_sql(value: str, mirror: bool = False) -> str:
    """CTEs up to ``nine`` (image_id, m, n, s: structs of w, c, e) by joins on shifted
    coordinates: the rule of the image library, written apart from the Spark windows."""
    other = "b.v, " if mirror else ""
    back = "a.v, " if mirror else ""
    return f"""px AS MATERIALIZED (SELECT image_id, y, x, {value} AS v FROM pix),
rw AS MATERIALIZED (SELECT p.image_id, p.y, p.x, struct_pack(w := coalesce(a.v, {other}p.v), c := p.v, e := coalesce(b.v, {back}p.v)) AS r FROM px p
  LEFT JOIN px a ON a.image_id = p.image_id AND a.y = p.y AND a.x = p.x - 1
  LEFT JOIN px b ON b.image_id = p.image_id AND b.y = p.y AND b.x = p.x + 1),
nine AS MATERIALIZED (SELECT p.image_id, p.y, p.x, p.r AS m, coalesce(a.r, {other.replace('.v', '.r')}p.r) AS n, coalesce(b.r, {back.replace('.v', '.r')}p.r) AS s FROM rw p
  LEFT JOIN rw a ON a.image_id = p.image_id AND a.x = p.x AND a.y = p.y - 1
  LEFT JOIN rw b ON b.image_id = p.image_id AND b.x = p.x AND b.y = p.y + 1)"""


def oracles() -> dict[str, str]:
    return {
        "px_basic_stats": f"""WITH {PIX},
m AS (SELECT image_id, avg(v) AS mean, stddev_pop(v) AS std FROM pix GROUP BY image_id),
g AS (SELECT p.image_id, avg(m.mean) AS mean, quantile_cont(v, 0.5) AS median, avg(m.std) AS std,
        avg(power(v - m.mean, 3)) AS m3, avg(power(v - m.mean, 2)) AS m2, avg(power(v - m.mean, 4)) AS m4,
        quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99,
        max(v) - min(v) AS value_range FROM pix p JOIN m ON m.image_id = p.image_id GROUP BY p.image_id)
SELECT image_id, round(mean, {R}) AS mean, round(median, {R}) AS median, round(std, {R}) AS std,
  round(CASE WHEN std < 1e-8 THEN 0.0e0 ELSE m3 / power(m2, 1.5) END, {R}) AS skew,
  round(CASE WHEN std < 1e-8 THEN 0.0e0 ELSE m4 / (m2 * m2) - 3.0e0 END, {R}) AS kurtosis,
  round(p1, {R}) AS p1, round(p5, {R}) AS p5, round(p95, {R}) AS p95, round(p99, {R}) AS p99, round(value_range, {R}) AS value_range FROM g""",
        "px_astro_stats": f"""WITH {PIX},
q AS (SELECT image_id, quantile_cont(v, 0.1) AS background, quantile_cont(v, 0.2) AS p20, max(v) AS peak, min(v) AS low FROM pix GROUP BY image_id),
n AS (SELECT p.image_id, coalesce(stddev_pop(CASE WHEN v < q.p20 THEN v END), 0.0e0) AS noise FROM pix p JOIN q ON q.image_id = p.image_id GROUP BY p.image_id)
SELECT q.image_id, round(background, {R}) AS background, round(noise, {R}) AS noise, round(peak - background, {R}) AS signal,
  round((peak - background) / (noise + 1e-8), {R}) AS snr, round(peak - low, {R}) AS dynamic_range FROM q JOIN n ON n.image_id = q.image_id""",
        "px_shape_stats": f"""WITH {PIX},
c AS (SELECT image_id, sum(v) AS flux, sum(x * v) / sum(v) AS xc, sum(y * v) / sum(v) AS yc FROM pix GROUP BY image_id),
m AS (SELECT p.image_id, sum((x - xc) * (x - xc) * v) / sum(v) AS mxx, sum((y - yc) * (y - yc) * v) / sum(v) AS myy,
        sum((x - xc) * (y - yc) * v) / sum(v) AS mxy FROM pix p JOIN c ON c.image_id = p.image_id GROUP BY p.image_id),
r AS (SELECT image_id, sum(v) OVER (PARTITION BY image_id ORDER BY v DESC, y, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM pix),
k AS (SELECT r.image_id, sum(CASE WHEN cum < flux * 0.2e0 - abs(flux) * 1e-9 THEN 1 ELSE 0 END) AS n20,
        sum(CASE WHEN cum < flux * 0.8e0 - abs(flux) * 1e-9 THEN 1 ELSE 0 END) AS n80
      FROM r JOIN c ON c.image_id = r.image_id GROUP BY r.image_id)
SELECT c.image_id, round(xc, {R}) AS xc, round(yc, {R}) AS yc,
  round(CASE WHEN flux < 1e-8 THEN 0.0e0 ELSE sqrt((mxx - myy) * (mxx - myy) + 4.0e0 * mxy * mxy) / (mxx + myy + 1e-8) END, {R}) AS ellipticity,
  round(CASE WHEN flux < 1e-8 THEN 0.0e0 ELSE 2.355e0 * sqrt((mxx + myy) / 2) END, {R}) AS fwhm,
  round(CASE WHEN flux < 1e-8 THEN 0.0e0 ELSE sqrt(n80 / pi()) / (sqrt(n20 / pi()) + 1e-8) END, {R}) AS concentration,
  round(0.5e0 * atan2(2.0e0 * mxy, mxx - myy), {R}) AS position_angle
FROM c JOIN m ON m.image_id = c.image_id JOIN k ON k.image_id = c.image_id""",
        "px_asymmetry": f"""WITH {PIX},
c AS (SELECT image_id, CAST(floor(sum(x * v) / sum(v)) AS INTEGER) AS cx, CAST(floor(sum(y * v) / sum(v)) AS INTEGER) AS cy,
        max(y) + 1 AS h, max(x) + 1 AS w FROM pix GROUP BY image_id),
b AS (SELECT image_id, greatest(0, cy - CAST(floor(h / 4) AS INTEGER)) AS y0, least(h, cy + CAST(floor(h / 4) AS INTEGER)) AS y1,
        greatest(0, cx - CAST(floor(w / 4) AS INTEGER)) AS x0, least(w, cx + CAST(floor(w / 4) AS INTEGER)) AS x1 FROM c),
i AS (SELECT p.image_id, p.y, p.x, p.v, b.y0, b.y1, b.x0, b.x1 FROM pix p JOIN b ON b.image_id = p.image_id
      WHERE p.y >= b.y0 AND p.y < b.y1 AND p.x >= b.x0 AND p.x < b.x1),
rt AS (SELECT image_id, y0 + y1 - 1 - y AS y, x0 + x1 - 1 - x AS x, v AS vb FROM i),
j AS (SELECT coalesce(i.image_id, rt.image_id) AS image_id, coalesce(i.v, 0.0e0) AS va, coalesce(rt.vb, 0.0e0) AS vb
      FROM i FULL OUTER JOIN rt ON i.image_id = rt.image_id AND i.y = rt.y AND i.x = rt.x),
g AS (SELECT image_id, sum(abs(va - vb)) AS d, sum(va) AS s FROM j GROUP BY image_id)
SELECT b.image_id, round(coalesce(d / (s + 1e-8), 0.0e0), {R}) AS asymmetry FROM b LEFT JOIN g ON g.image_id = b.image_id""",
        "px_vegetation": f"""WITH {PIX},
p AS (SELECT image_id, (nir - red) / (nir + red + 1e-8) AS ndvi, 2.5e0 * (nir - red) / (nir + 6.0e0 * red - 7.5e0 * blue + 1.0e0 + 1e-8) AS evi,
        (green - nir) / (green + nir + 1e-8) AS ndwi FROM pix)
SELECT image_id, round(avg(ndvi), {R}) AS ndvi_mean, round(stddev_pop(ndvi), {R}) AS ndvi_std, round(max(ndvi), {R}) AS ndvi_max,
  round(min(ndvi), {R}) AS ndvi_min, round(avg(CASE WHEN ndvi > 0.3 THEN 1.0e0 ELSE 0.0e0 END), {R}) AS vegetation_fraction,
  round(avg(CASE WHEN ndvi > 0.6 THEN 1.0e0 ELSE 0.0e0 END), {R}) AS dense_vegetation_fraction,
  round(avg(CASE WHEN ndvi > 0.1 AND ndvi <= 0.3 THEN 1.0e0 ELSE 0.0e0 END), {R}) AS sparse_vegetation_fraction,
  round(avg(evi), {R}) AS evi_mean, round(stddev_pop(evi), {R}) AS evi_std, round(max(evi), {R}) AS evi_max,
  round(avg(ndwi), {R}) AS ndwi_mean, round(avg(CASE WHEN ndwi > 0 THEN 1.0e0 ELSE 0.0e0 END), {R}) AS water_content,
  round(1.0e0 - avg(ndwi), {R}) AS water_stress_index FROM p GROUP BY image_id""",
        "px_focus": f"""WITH {PIX},
gx AS (SELECT a.image_id, a.y, a.x, CASE WHEN r.v IS NOT NULL AND l.v IS NOT NULL THEN (r.v - l.v) / 2 WHEN r.v IS NOT NULL THEN r.v - a.v
          WHEN l.v IS NOT NULL THEN a.v - l.v ELSE 0.0e0 END AS gx
       FROM pix a LEFT JOIN pix r ON r.image_id = a.image_id AND r.y = a.y AND r.x = a.x + 1
       LEFT JOIN pix l ON l.image_id = a.image_id AND l.y = a.y AND l.x = a.x - 1),
gy AS (SELECT a.image_id, a.y, a.x, CASE WHEN d.v IS NOT NULL AND u.v IS NOT NULL THEN (d.v - u.v) / 2 WHEN d.v IS NOT NULL THEN d.v - a.v
          WHEN u.v IS NOT NULL THEN a.v - u.v ELSE 0.0e0 END AS gy
       FROM pix a LEFT JOIN pix d ON d.image_id = a.image_id AND d.x = a.x AND d.y = a.y + 1
       LEFT JOIN pix u ON u.image_id = a.image_id AND u.x = a.x AND u.y = a.y - 1),
g AS (SELECT gx.image_id, avg(sqrt(gx * gx + gy * gy)) AS gf, avg(abs(gx)) AS mdx, avg(abs(gy)) AS mdy
      FROM gx JOIN gy ON gy.image_id = gx.image_id AND gy.y = gx.y AND gy.x = gx.x GROUP BY gx.image_id)
SELECT image_id, round(gf, {R}) AS gradient_focus, round(abs(mdx - mdy) / (mdx + mdy + 1e-8), {R}) AS motion FROM g""",
        "px_laplacian": f"""WITH {PIX}, {around_sql("CAST(CAST(trunc(v * 255.0e0) AS BIGINT) % 256 AS DOUBLE)", True)},
l AS (SELECT image_id, n.c + s.c + m.w + m.e - 4.0e0 * m.c AS lap FROM nine),
g AS (SELECT image_id, var_pop(lap) AS lv, count(*) AS n_pixels FROM l GROUP BY image_id)
SELECT image_id, round(lv, {R}) AS laplacian_variance, n_pixels, round(least(1.0e0, lv / 500.0e0), {R}) AS focus_score,
  CASE WHEN least(1.0e0, lv / 500.0e0) < 0.3 THEN 1.0e0 ELSE 0.0e0 END AS is_out_of_focus FROM g""",
        "px_box_mean": f"""WITH {PIX},
r AS (SELECT image_id, y, x, avg(v) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rx,
        count(v) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS cx FROM pix),
c AS (SELECT image_id, y, x, avg(rx) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS bm,
        min(cx) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mcx,
        count(rx) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS cy FROM r)
SELECT image_id, y, x, round(bm, {R}) AS box_mean FROM c WHERE mcx = 3 AND cy = 3""",
    }


def px_morphology(spark, sf):
    # read by ~10 branches (shape moments, running flux, crop, mirror): keep once
    p = pixel_table(spark, sf).persist()
    s = pixels.morphology(pixels.shape_stats(p), pixels.asymmetry(p))
    return _r(s, ["star_likelihood", "galaxy_likelihood", "spiral_likelihood", "elliptical_likelihood"])


def px_seeing(spark, sf):
    return _r(pixels.seeing(pixel_table(spark, sf)), ["seeing_fwhm"])


def px_sobel(spark, sf):
    s = pixels.sobel_sharpness(pixel_table(spark, sf))
    return s.select("image_id", F.round("sharpness", R).alias("sharpness"), "n_pixels")


def px_cosmic_rays(spark, sf):
    s = pixels.cosmic_rays(pixel_table(spark, sf))
    return s.select("image_id", "n_replaced", F.round("clean_mean", R).alias("clean_mean"))


def px_glcm(spark, sf):
    s = pixels.glcm(pixel_table(spark, sf))
    return _r(s, ["contrast", "dissimilarity", "homogeneity", "energy", "correlation"])


QUERIES.update({
    "px_morphology": px_morphology,
    "px_seeing": px_seeing,
    "px_sobel": px_sobel,
    "px_cosmic_rays": px_cosmic_rays,
    "px_glcm": px_glcm,
})

_base_oracles = oracles


def oracles() -> dict[str, str]:  # noqa: F811
    o = _base_oracles()
    # inner values at 12 decimals so only the final result is rounded to 6
    shape = o["px_shape_stats"].replace(f", {R})", ", 12)")
    asym = o["px_asymmetry"].replace(f", {R})", ", 12)")
    o["px_morphology"] = f"""WITH s AS ({shape}), a AS ({asym}),
j AS (SELECT s.image_id, s.concentration, a.asymmetry FROM s JOIN a ON a.image_id = s.image_id)
SELECT image_id, round(least(1.0e0, greatest(0.0e0, (concentration - 1.5e0) / 2.0e0)), {R}) AS star_likelihood,
  round(1.0e0 - least(1.0e0, greatest(0.0e0, (concentration - 1.5e0) / 2.0e0)), {R}) AS galaxy_likelihood,
  round(CASE WHEN asymmetry > 0.2 THEN least(1.0e0, asymmetry * 2) ELSE 0.0e0 END, {R}) AS spiral_likelihood,
  round(1.0e0 - CASE WHEN asymmetry > 0.2 THEN least(1.0e0, asymmetry * 2) ELSE 0.0e0 END, {R}) AS elliptical_likelihood FROM j"""
    o["px_seeing"] = f"""WITH {PIX},
pk AS (SELECT image_id, y AS py, x AS px FROM (SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS rn FROM pix) WHERE rn = 1),
j AS (SELECT p.* FROM pix p JOIN pk ON pk.image_id = p.image_id WHERE p.y >= py - 15 AND p.y < py + 15 AND p.x >= px - 15 AND p.x < px + 15),
c AS (SELECT image_id, count(*) AS n, sum(v) AS t, sum(y * v) / sum(v) AS yc, sum(x * v) / sum(v) AS xc FROM j GROUP BY image_id),
k AS (SELECT j.image_id, any_value(c.n) AS n, any_value(c.t) AS t, sqrt(sum((y - yc) * (y - yc) * v) / any_value(c.t)) AS sy,
        sqrt(sum((x - xc) * (x - xc) * v) / any_value(c.t)) AS sx FROM j JOIN c ON c.image_id = j.image_id GROUP BY j.image_id)
SELECT image_id, round(CASE WHEN n < 9 OR t < 1e-8 THEN 0.0e0 ELSE 2.355e0 * (sx + sy) / 2 * 1.0e0 END, {R}) AS seeing_fwhm FROM k"""
    gy = "((s.w + 2 * s.c + s.e) - (n.w + 2 * n.c + n.e))"
    gx = "((n.e + 2 * m.e + s.e) - (n.w + 2 * m.w + s.w))"
    o["px_sobel"] = f"""WITH {PIX}, {around_sql("v")}
SELECT image_id, round(avg(sqrt({gx} * {gx} + {gy} * {gy})), {R}) AS sharpness, count(*) AS n_pixels FROM nine GROUP BY image_id"""
    o["px_cosmic_rays"] = f"""WITH {PIX}, {around_sql("v")},
d AS (SELECT image_id, m.c AS val, list_sort([n.w, n.c, n.e, m.w, m.c, m.e, s.w, s.c, s.e])[5] AS med FROM nine),
m1 AS (SELECT image_id, quantile_cont(val - med, 0.5) AS md FROM d GROUP BY image_id),
d2 AS (SELECT d.*, val - med AS diff, m1.md FROM d JOIN m1 ON m1.image_id = d.image_id),
mad AS (SELECT image_id, quantile_cont(abs(diff - md), 0.5) AS mad FROM d2 GROUP BY image_id),
d3 AS (SELECT d2.*, mad.mad FROM d2 JOIN mad ON mad.image_id = d2.image_id)
SELECT image_id, CAST(sum(CASE WHEN abs(diff) > 5.0e0 * 1.4826e0 * mad THEN 1 ELSE 0 END) AS BIGINT) AS n_replaced,
  round(avg(CASE WHEN abs(diff) > 5.0e0 * 1.4826e0 * mad THEN med ELSE val END), {R}) AS clean_mean FROM d3 GROUP BY image_id"""
    offs_g = {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1)}
    pr = " UNION ALL ".join(
        f"SELECT a.image_id, {ang} AS angle, a.q AS i, b.q AS j FROM g a JOIN g b ON b.image_id = a.image_id AND b.y = a.y + ({dy}) AND b.x = a.x + ({dx})"
        for ang, (dy, dx) in offs_g.items())
    o["px_glcm"] = f"""WITH {PIX},
g AS (SELECT image_id, y, x, CAST(floor(v * 255.0e0) AS INTEGER) AS q FROM pix),
pr AS ({pr}),
u AS (SELECT image_id, angle, i, j FROM pr UNION ALL SELECT image_id, angle, j, i FROM pr),
c AS (SELECT image_id, angle, i, j, count(*) AS c FROM u GROUP BY ALL),
p AS (SELECT *, c * 1.0e0 / sum(c) OVER (PARTITION BY image_id, angle) AS p FROM c),
m AS (SELECT *, sum(i * p) OVER (PARTITION BY image_id, angle) AS mi, sum(j * p) OVER (PARTITION BY image_id, angle) AS mj FROM p),
a AS (SELECT image_id, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity,
        sum(p / (1.0e0 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy,
        sum(p * (i - mi) * (j - mj)) AS cov, sqrt(sum(p * (i - mi) * (i - mi))) AS si, sqrt(sum(p * (j - mj) * (j - mj))) AS sj
      FROM m GROUP BY image_id, angle)
SELECT image_id, round(avg(contrast), {R}) AS contrast, round(avg(dissimilarity), {R}) AS dissimilarity, round(avg(homogeneity), {R}) AS homogeneity,
  round(avg(energy), {R}) AS energy, round(avg(CASE WHEN si < 1e-15 OR sj < 1e-15 THEN 1.0e0 ELSE cov / (si * sj) END), {R}) AS correlation FROM a GROUP BY image_id"""
    return o


def px_land_cover(spark, sf):
    s = pixels.land_cover(pixel_table(spark, sf), "nir", "red", "green", "blue")
    return _r(s, ["vegetation_cover", "water_cover", "urban_cover", "barren_cover", "land_cover_diversity"])


COVERS = ["forest_cover_fraction", "forest_health_index", "forest_fragmentation", "water_body_fraction", "water_quality_index", "agriculture_fraction", "crop_health"]


def px_derived_covers(spark, sf):
    return _r(pixels.derived_covers(pixel_table(spark, sf), "nir", "red", "green", "blue"), COVERS)


def px_size_profile(spark, sf):
    return pixels.size_profile(pixel_table(spark, sf), ["v", "red", "green", "blue", "nir"])


def px_roughness(spark, sf):
    s = pixels.roughness(pixel_table(spark, sf))
    return _r(s, ["rms_roughness", "mean_roughness", "peak_to_valley", "height_skewness", "height_kurtosis"])


QUERIES.update({"px_land_cover": px_land_cover, "px_derived_covers": px_derived_covers, "px_size_profile": px_size_profile, "px_roughness": px_roughness})

_base_oracles2 = oracles


def oracles() -> dict[str, str]:  # noqa: F811
    o = _base_oracles2()
    o["px_land_cover"] = f"""WITH {PIX},
g AS (SELECT image_id, avg(CASE WHEN (nir - red) / (nir + red + 1e-8) > 0.3 THEN 1.0e0 ELSE 0.0e0 END) AS veg,
        avg(CASE WHEN (green - nir) / (green + nir + 1e-8) > 0 THEN 1.0e0 ELSE 0.0e0 END) AS wat,
        avg(CASE WHEN (blue - nir) / (blue + nir + 1e-8) > 0 THEN 1.0e0 ELSE 0.0e0 END) AS urb FROM pix GROUP BY image_id),
h AS (SELECT *, greatest(0.0e0, 1.0e0 - veg - wat - urb) AS bar FROM g)
SELECT image_id, round(veg, {R}) AS vegetation_cover, round(wat, {R}) AS water_cover, round(urb, {R}) AS urban_cover,
  round(bar, {R}) AS barren_cover, round(1.0e0 - (veg * veg + wat * wat + urb * urb + bar * bar), {R}) AS land_cover_diversity FROM h"""
    o["px_derived_covers"] = f"""WITH {PIX},
g AS (SELECT image_id, avg(CASE WHEN (nir - red) / (nir + red + 1e-8) > 0.6 THEN 1.0e0 ELSE 0.0e0 END) AS forest, avg((nir - red) / (nir + red + 1e-8)) AS ndvi,
        avg(CASE WHEN (nir - red) / (nir + red + 1e-8) > 0.3 THEN 1.0e0 ELSE 0.0e0 END) AS veg,
        avg(CASE WHEN (green - nir) / (green + nir + 1e-8) > 0.3 THEN 1.0e0 ELSE 0.0e0 END) AS water, avg((green - blue) / (green + blue + 1e-8)) AS mndwi FROM pix GROUP BY image_id)
SELECT image_id, round(forest, {R}) AS forest_cover_fraction, round(ndvi, {R}) AS forest_health_index, round(1 - forest / (forest + 0.1e0), {R}) AS forest_fragmentation,
  round(water, {R}) AS water_body_fraction, round(mndwi, {R}) AS water_quality_index, round(veg * 0.8e0, {R}) AS agriculture_fraction, round(ndvi, {R}) AS crop_health FROM g"""
    o["px_size_profile"] = f"""WITH {PIX}, p AS (SELECT image_id, CAST(max(x) - min(x) + 1 AS INTEGER) AS width, CAST(max(y) - min(y) + 1 AS INTEGER) AS height,
  CAST((count(v) > 0)::INT + (count(red) > 0)::INT + (count(green) > 0)::INT + (count(blue) > 0)::INT + (count(nir) > 0)::INT AS INTEGER) AS channels FROM pix GROUP BY image_id)
SELECT width, height, channels, count(*) AS images FROM p GROUP BY width, height, channels"""
    o["px_roughness"] = f"""WITH {PIX},
r AS (SELECT image_id, y, x, v, sum(v) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS sx,
        count(v) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS cx FROM pix),
lp AS (SELECT image_id, v - sum(sx) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)
        / sum(cx) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS h FROM r),
m AS (SELECT image_id, avg(h) AS mh, stddev_pop(h) AS sh FROM lp GROUP BY image_id),
z AS (SELECT lp.image_id, h, sh, (h - mh) / (sh + 1e-8) AS z FROM lp JOIN m ON m.image_id = lp.image_id)
SELECT image_id, round(any_value(sh), {R}) AS rms_roughness, round(avg(abs(h)), {R}) AS mean_roughness, round(max(h) - min(h), {R}) AS peak_to_valley,
  round(avg(z * z * z), {R}) AS height_skewness, round(avg(z * z * z * z) - 3.0e0, {R}) AS height_kurtosis FROM z GROUP BY image_id"""
    return o
