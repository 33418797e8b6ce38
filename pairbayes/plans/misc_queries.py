"""Registered catalogue / path-string / colour / noise queries and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.functions.columns import coord_from_name, dataset_name, safe_label, safe_name
from pairbayes.operators import colours
from pairbayes.operators.noise import add_noise
from pairbayes.session import table
from pairbayes.sources import catalogue

R = 6
# colour values carry 7 decimals (price / 1e5): round at 9 to stay off halves
RC = 9
URL_PATH = r"^[a-z]+://[^/]+(/[^?#]*)"


def _pages_catalogue(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    p = p.withColumn("path", F.regexp_extract("url", URL_PATH, 1))
    return p, catalogue.catalogue_from_paths(p, F.col("path"), "/")


def page_catalogue(spark, sf) -> DataFrame:
    """(path, class, filename) from page URLs (class = first folder)."""
    _, c = _pages_catalogue(spark, sf)
    return c


def page_class_index(spark, sf) -> DataFrame:
    """Sorted class -> index."""
    _, c = _pages_catalogue(spark, sf)
    return catalogue.class_index_map(c)


def page_class_validation(spark, sf) -> DataFrame:
    """The class map saved before the folder 'en' came, vs that of all pages; differing rows."""
    p, c = _pages_catalogue(spark, sf)
    saved = catalogue.catalogue_from_paths(p.where(~F.col("path").startswith("/en/")), F.col("path"), "/")
    bad = catalogue.validate_class_map(catalogue.class_index_map(saved), catalogue.class_index_map(c))
    return bad.select("class", *[F.coalesce(i, F.lit(-1)).alias(i) for i in ("saved_index", "current_index")])  # -1: absent


def page_merged_splits(spark, sf) -> DataFrame:
    """Http pages as 'train', https as 'test'; union, test wins per (class, filename)."""
    p = table(spark, sf, "pages").select("url").withColumn("path", F.regexp_extract("url", URL_PATH, 1))
    tr = catalogue.catalogue_from_paths(p.where(~F.col("url").startswith("https")), F.col("path"), "/").withColumn("split", F.lit("train"))
    te = catalogue.catalogue_from_paths(p.where(F.col("url").startswith("https")), F.col("path"), "/").withColumn("split", F.lit("test"))
    m = catalogue.merge_splits(tr, te)
    return m.groupBy("class", "split").agg(F.count(F.lit(1)).alias("n"))


def page_name_functions(spark, sf) -> DataFrame:
    """Safe file names, safe labels and dataset names from URLs."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", safe_name(F.col("url")).alias("safe_name"), safe_label(F.col("url")).alias("safe_label"),
                    dataset_name(F.regexp_replace(F.col("url"), r"^[a-z]+://[^/]+/", "data/")).alias("dataset"))


def customer_coordinates(spark, sf) -> DataFrame:
    """(ra, dec) parsed back from names built as obj_<acctbal>_<nation*1.25>.jpg."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    name = F.concat(F.lit("obj_"), F.col("c_acctbal").cast("string"), F.lit("_"),
                    (F.col("c_nationkey") * F.lit(1.25)).cast("string"), F.lit(".jpg"))
    ra, dec = coord_from_name(name)
    return c.select("c_custkey", ra.alias("ra"), dec.alias("dec"))


def _photometry(spark, sf, pre=None):
    li = table(spark, sf, "lineitem")
    if pre is not None:
        li = li.where(pre)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        (F.lit(20.0) + F.col("l_quantity") / 25.0).alias("modelMag_u"),
        (F.lit(19.5) + F.col("l_discount") * 10.0).alias("psfMag_g"),
        (F.lit(19.0) + F.col("l_tax") * 10.0).alias("r"),
        (F.lit(18.8) + F.col("l_extendedprice") / 100000.0).alias("modelMagi"),
        (F.lit(18.5) + F.col("l_discount") * 5.0).alias("psfMagz"),
        (F.col("l_discount") * 40.0).alias("redshift"))


LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def li_colours(spark, sf) -> DataFrame:
    """Colour indices with magnitude-name resolution and range filter."""
    c = colours.colour_indices(_photometry(spark, sf), keep=LI_KEY, redshift="redshift")
    return c.select(*LI_KEY, *[F.round(x, RC).alias(x) for x in ("u_g", "g_r", "r_i", "i_z", "redshift")])


def li_colour_shift(spark, sf) -> DataFrame:
    """Deterministic redshift colour shift to z=2.5, clipped."""
    c = colours.colour_indices(_photometry(spark, sf), keep=LI_KEY, redshift="redshift")
    s = colours.redshift_shift(c, 2.5)
    return s.select(*LI_KEY, *[F.round(x, RC).alias(x) for x in ("u_g", "g_r", "r_i", "i_z")])


def li_qso_selection(spark, sf) -> DataFrame:
    """P18 + J1: photometry joined to 'spectra' (orders; class QSO = status F,
    z = totalprice/100000), 0 < z < 4, magnitude window, top 2000 by key."""
    # Pushable pre-filters on the stored columns (supersets of the exact
    # conditions, which still follow): they reach the parquet scan.
    li_pre = F.col("l_quantity").between(5.0 - 1e-6, 45.0 + 1e-6)
    ph = _photometry(spark, sf, li_pre).where(F.col("modelMag_u").between(20.2, 21.8))
    orders = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 400001.0))
    sp = orders.select(F.col("o_orderkey").alias("l_orderkey"),
                                          F.when(F.col("o_orderstatus") == "F", "QSO").otherwise("STAR").alias("class"),
                                          (F.col("o_totalprice") / 100000.0).alias("z"))
    j = ph.join(sp, "l_orderkey", "inner").where((F.col("class") == "QSO") & (F.col("z") > 0) & (F.col("z") < 4))
    top = j.orderBy(*LI_KEY).limit(2000)
    return top.select(*LI_KEY, F.round("modelMag_u", RC).alias("u"), F.round("z", RC).alias("z"))


def px_noise(spark, sf) -> DataFrame:
    """Each noise kind applied to the pixel gray values (rows-only)."""
    from pairbayes.plans.pixel_queries import pixel_table

    p = pixel_table(spark, sf)
    key = F.concat_ws("_", "image_id", "y", "x")
    kinds = ["gaussian", "salt_pepper", "poisson", "speckle", "rayleigh", "exponential", "uniform"]
    return p.select("image_id", "y", "x", *[add_noise(F.col("v"), k, 0.05, 7 + i, key).alias(k) for i, k in enumerate(kinds)])


QUERIES = {
    "page_catalogue": page_catalogue,
    "page_class_index": page_class_index,
    "page_class_validation": page_class_validation,
    "page_merged_splits": page_merged_splits,
    "page_name_functions": page_name_functions,
    "customer_coordinates": customer_coordinates,
    "li_colours": li_colours,
    "li_colour_shift": li_colour_shift,
    "li_qso_selection": li_qso_selection,
    "px_noise": px_noise,
}

_CAT = r"""cat AS (SELECT path, CASE WHEN len(string_split(path[2:], '/')) > 1 THEN string_split(path[2:], '/')[1] ELSE 'unknown' END AS class,
                string_split(path[2:], '/')[-1] AS filename, url FROM (SELECT url, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages))"""

_PHOT = """ph AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 20.0e0 + l_quantity / 25.0e0 AS mu,
   19.5e0 + l_discount * 10.0e0 AS mg, 19.0e0 + l_tax * 10.0e0 AS mr, 18.8e0 + l_extendedprice / 100000.0e0 AS mi,
   18.5e0 + l_discount * 5.0e0 AS mz, l_discount * 40.0e0 AS redshift FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, mu - mg AS u_g, mg - mr AS g_r, mr - mi AS r_i, mi - mz AS i_z, redshift FROM ph
   WHERE mu - mg > -1 AND mu - mg < 3 AND mg - mr > -1 AND mg - mr < 3 AND mr - mi > -1 AND mr - mi < 3 AND mi - mz > -1 AND mi - mz < 3)"""


def oracles() -> dict[str, str]:
    key = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
    dz = "(2.5e0 - redshift)"
    return {
        "page_catalogue": f"WITH {_CAT} SELECT path, class, filename FROM cat",
        "page_class_index": f"WITH {_CAT} SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS class_index FROM (SELECT DISTINCT class FROM cat)",
        "page_class_validation": f"""WITH {_CAT},
s AS (SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS ci FROM (SELECT DISTINCT class FROM cat WHERE path NOT LIKE '/en/%')),
c2 AS (SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS ci FROM (SELECT DISTINCT class FROM cat))
SELECT coalesce(s.class, c2.class) AS class, coalesce(s.ci, -1) AS saved_index, coalesce(c2.ci, -1) AS current_index FROM s FULL OUTER JOIN c2 ON s.class = c2.class
WHERE s.class IS NULL OR c2.class IS NULL OR s.ci <> c2.ci""",
        "page_merged_splits": f"""WITH {_CAT},
u AS (SELECT path, class, filename, CASE WHEN url LIKE 'https%' THEN 'test' ELSE 'train' END AS split, CASE WHEN url LIKE 'https%' THEN 1 ELSE 0 END AS o FROM cat),
r AS (SELECT *, row_number() OVER (PARTITION BY class, filename ORDER BY o DESC, path DESC) AS rn FROM u)
SELECT class, split, count(*) AS n FROM r WHERE rn = 1 GROUP BY class, split""",
        "page_name_functions": r"""SELECT page_id, regexp_replace(url, '[^\w\-.]', '_', 'g') AS safe_name, regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') AS safe_label,
  CASE WHEN coalesce(regexp_extract(d, 'data/([^/]+)', 1), '') <> '' THEN regexp_extract(d, 'data/([^/]+)', 1)
       WHEN regexp_extract(d, '([^/]*?)(\.[^./]*)?$', 1) = '' THEN 'unknown_dataset' ELSE regexp_extract(d, '([^/]*?)(\.[^./]*)?$', 1) END AS dataset
FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://[^/]+/', 'data/') AS d FROM pages)""",
        "customer_coordinates": r"""SELECT c_custkey, round_even(CAST(regexp_extract(n, '(-?\d+\.\d+)[_-](-?\d+\.\d+)', 1) AS DOUBLE), 2) AS ra,
  round_even(CAST(regexp_extract(n, '(-?\d+\.\d+)[_-](-?\d+\.\d+)', 2) AS DOUBLE), 2) AS dec
FROM (SELECT c_custkey, 'obj_' || CAST(c_acctbal AS VARCHAR) || '_' || CAST(c_nationkey * 1.25e0 AS VARCHAR) || '.jpg' AS n FROM customer)""",
        "li_colours": f"WITH {_PHOT} SELECT {key}, round(u_g, {RC}) AS u_g, round(g_r, {RC}) AS g_r, round(r_i, {RC}) AS r_i, round(i_z, {RC}) AS i_z, round(redshift, {RC}) AS redshift FROM c",
        "li_colour_shift": f"""WITH {_PHOT} SELECT {key},
  round(least(3.0e0, greatest(-0.5e0, u_g + 0.7e0 * {dz})), {RC}) AS u_g, round(least(2.0e0, greatest(-0.5e0, g_r + 0.2e0 * {dz})), {RC}) AS g_r,
  round(least(1.0e0, greatest(-0.5e0, r_i + 0.1e0 * {dz})), {RC}) AS r_i, round(least(0.8e0, greatest(-0.5e0, i_z + 0.05e0 * {dz})), {RC}) AS i_z FROM c""",
        "li_qso_selection": f"""SELECT {key}, round(u, {RC}) AS u, round(z, {RC}) AS z FROM (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, 20.0e0 + l.l_quantity / 25.0e0 AS u, o.o_totalprice / 100000.0e0 AS z
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  WHERE 20.0e0 + l.l_quantity / 25.0e0 BETWEEN 20.2e0 AND 21.8e0 AND o.o_orderstatus = 'F' AND o.o_totalprice / 100000.0e0 > 0 AND o.o_totalprice / 100000.0e0 < 4
  ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate LIMIT 2000)""",
    }


def customer_sky_list(spark, sf) -> DataFrame:
    """Coordinate columns found by name (last containing RA / DEC),
    rows with null coordinates dropped; object name from ``rec``, else from
    ``SDSS_Obj``, else from the place in the list."""
    from pairbayes.sources.sinks import coordinate_columns, object_names

    third = F.col("c_nationkey") % 3
    c = table(spark, sf, "customer").select(
        F.when(third == 0, F.col("c_custkey")).alias("rec"), F.when(third == 1, F.col("c_name")).alias("SDSS_Obj"), F.col("c_custkey").alias("place"),
        F.col("c_acctbal").alias("_RAJ2000"), F.col("c_nationkey").cast("double").alias("DEC_deg"))
    ra, dec = coordinate_columns(c)
    return c.where(F.col(ra).isNotNull() & F.col(dec).isNotNull()).select(
        object_names(c, "sky", place=F.col("place")).alias("name"), F.col(ra).alias("ra"), F.col(dec).alias("dec"))


QUERIES["customer_sky_list"] = customer_sky_list

_misc_oracles_base = oracles


def oracles() -> dict[str, str]:  # noqa: F811
    o = _misc_oracles_base()
    o["customer_sky_list"] = """SELECT CASE c_nationkey % 3 WHEN 0 THEN 'sky_' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'sky_' || c_name
  ELSE 'sky_obj_' || CASE WHEN c_custkey < 1000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END END AS name, c_acctbal AS ra, CAST(c_nationkey AS DOUBLE) AS dec
FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL"""
    return o
