"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed separators tried by the sniffing rule, in order.
SEPARATORS = [",", ";", "\t", " "]


def read_csv_table(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema=None,
                   target: str | None = None) -> DataFrame:
    """CSV with separator/header; the target column is cast to string."""
    r = spark.read.option("sep", sep).option("header", str(header).lower())
    df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", "true").csv(path)
    if target is not None:
        df = df.withColumn(target, F.col(target).cast("string"))
    return df


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The first separator of , ; tab space found in the first line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0]["value"] if first else ""
    for s in SEPARATORS:
        if s in line:
            return s
    return ","


def select_configured(df: DataFrame, column_names: Sequence[str] | None) -> DataFrame:
    """Keep configured columns that exist; '#'-prefixed names are
    excluded; when none is valid the frame is returned unchanged."""
    if not column_names:
        return df
    keep = [c for c in column_names if not c.startswith("#") and c in df.columns]
    return df.select(*keep) if keep else df


def check_columns(df: DataFrame, column_names: Sequence[str] | None, target: str | int | None) -> str | None:
    """S3: configured columns must exist, the target must exist; an integer
    target is resolved to the name at that position."""
    cols = df.columns
    if column_names:
        missing = [c for c in column_names if not c.startswith("#") and c not in cols]
        if missing:
            raise ValueError(f"columns not in data: {missing}")
    if target is None:
        return None
    if isinstance(target, int):
        if not 0 <= target < len(cols):
            raise ValueError(f"target position {target} out of range")
        return cols[target]
    if target not in cols:
        raise ValueError(f"target column {target!r} not in data")
    return target


def coordinate_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """The last column whose upper-case name contains RA (or _RAJ2000)
    and the last containing DEC (or _DEJ2000)."""
    ra = dec = None
    for c in df.columns:
        u = c.upper()
        if "_RAJ2000" in u or "RA" in u:
            ra = c
        if "_DEJ2000" in u or "DEC" in u:
            dec = c
    return ra, dec


def write_predictions(pred: DataFrame, path: str, partition_cols: Sequence[str] = ("split", "correct")) -> None:
    """all/correct/failed/train/test become partitions of one table."""
    pred.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)


def deterministic_columns(pred: DataFrame, priority: Sequence[str], order_by: str) -> DataFrame:
    """Priority columns first, the rest alphabetical, rows ordered."""
    rest = sorted(c for c in pred.columns if c not in priority)
    return pred.select(*[c for c in priority if c in pred.columns], *rest).orderBy(order_by)


def feature_columns(df: DataFrame, vec: str, n: int, keep: Sequence[str] = ()) -> DataFrame:
    """``feature_0..feature_{n-1}`` columns from an array (truncated to n)."""
    return df.select(*[F.col(vec)[i].alias(f"feature_{i}") for i in range(n)], *keep)


def write_split(split: DataFrame, path: str) -> None:
    """``(row_id, split)`` keyed by id (not by position)."""
    split.select("row_id", "split").write.mode("overwrite").parquet(path)


def attach_split(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """S14 reload: inner join keeps only ids still present."""
    return df.join(spark.read.parquet(path), "row_id", "inner")


def append_epoch_snapshot(split: DataFrame, path: str, epoch: int) -> None:
    """The split of one epoch, partitioned by epoch; an epoch that runs again replaces its own rows."""
    rows = split.select(F.lit(epoch).alias("epoch"), "row_id", "split")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


def object_names(df: DataFrame, base: str, number: str = "rec", name: str = "SDSS_Obj", place: Column | None = None) -> Column:
    """File name of a listed object: base and record number, else base and object name, else base
    and its place in the list (four digits).  Either column may be missing."""
    choices = []
    if number in df.columns:
        known = F.col(number).isNotNull() & ~F.isnan(F.col(number).cast("double"))
        choices.append(F.when(known, F.concat(F.lit(f"{base}_"), F.col(number).cast("long").cast("string"))))
    if name in df.columns:
        choices.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{base}_"), F.col(name).cast("string"))))
    if place is not None:
        digits = place.cast("string")
        choices.append(F.concat(F.lit(f"{base}_obj_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)))
    return F.coalesce(*choices)
