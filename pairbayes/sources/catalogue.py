"""File catalogues as tables.

A catalogue is ``(path, class, filename)``; class = the first folder below the
root (``unknown`` for files at the root).  ``binary_catalogue`` reads real
folders with Spark's ``binaryFile`` source (paths only, no content)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed list of image extensions the catalogue accepts.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "bmp", "tif", "tiff", "fits", "fit", "dcm", "gif", "webp"]


def catalogue_from_paths(df: DataFrame, path: Column, root: str = "/") -> DataFrame:
    """class = first folder below ``root``; filename = last segment; the
    caller orders by ``path`` when it needs the deterministic order."""
    rel = F.regexp_replace(path, "^" + root.rstrip("/") + "/", "")
    parts = F.split(rel, "/")
    cls = F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("unknown"))
    return df.select(path.alias("path"), cls.alias("class"), F.element_at(parts, -1).alias("filename"))


def binary_catalogue(spark: SparkSession, root: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """S6 on a real folder tree: binaryFile listing (content column pruned); extensions
    in any case, and with ``.gz`` behind them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    files = files.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + r")(\.gz)?$"))
    return catalogue_from_paths(files, F.regexp_replace(F.col("path"), "^file:", ""), root)


def class_index_map(cat: DataFrame) -> DataFrame:
    """Sorted class names -> 0..C-1 (window over distinct classes only)."""
    d = cat.select("class").distinct()
    return d.select("class", (F.row_number().over(Window.orderBy("class")) - 1).cast("int").alias("class_index"))


def validate_class_map(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Rows where the saved and current maps disagree (empty = valid)."""
    j = saved.alias("s").join(current.alias("c"), F.col("s.class") == F.col("c.class"), "full_outer")
    return j.where(F.col("s.class").isNull() | F.col("c.class").isNull() | (F.col("s.class_index") != F.col("c.class_index"))).select(
        F.coalesce(F.col("s.class"), F.col("c.class")).alias("class"),
        F.col("s.class_index").alias("saved_index"), F.col("c.class_index").alias("current_index"))


def merge_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Union of two split catalogues per class; for the same (class,
    filename) the later split (test) wins."""
    u = train.withColumn("__order", F.lit(0)).unionByName(test.withColumn("__order", F.lit(1)))
    w = Window.partitionBy("class", "filename").orderBy(F.col("__order").desc(), F.col("path").desc())
    return u.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn", "__order")
