"""Label and category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_list(fx: DataFrame, label: str = "label") -> list[str]:
    """Sorted distinct labels (the label-encoder order).  The class set is
    bounded by the number of classes, so it is safe to bring to the driver."""
    rows = fx.select(F.col(label).cast("string").alias("l")).where(F.col("l").isNotNull()).distinct().collect()
    return sorted(r["l"] for r in rows)


def label_codes(fx: DataFrame, label: str = "label") -> DataFrame:
    """``(label, code)`` where code = rank of the label string (0-based).

    Computed on the distinct labels only, so the un-partitioned window sees at
    most one row per class."""
    d = fx.select(F.col(label).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()
    return d.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("code"))


def encode_labels(fx: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """Attach ``y`` = position of the label in the sorted class list.  Unknown
    labels get null.  The class list is a literal (tiny), no join needed."""
    arr = F.lit(list(classes))
    return fx.withColumn("y", (F.array_position(arr, F.col(label)) - 1).cast("int")).withColumn(
        "y", F.when(F.col("y") >= 0, F.col("y"))
    )


def first_appearance_codes(df: DataFrame, columns: Sequence[str], order_col: str) -> DataFrame:
    """Per column, code = order of first appearance of each value (by
    ``order_col``), 0-based.  Returns ``(column_name, value, code)``.

    One group-by per column computes the first position of every distinct value
    (partial aggregation keeps the shuffle at one row per value per task); the
    ranking window runs per column over distinct values only."""
    parts = []
    for c in columns:
        parts.append(
            df.where(F.col(c).isNotNull())
            .groupBy(F.col(c).cast("string").alias("value"))
            .agg(F.min(order_col).alias("first_pos"))
            .withColumn("column_name", F.lit(c))
        )
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy("column_name").orderBy("first_pos", "value")
    return u.select("column_name", "value", (F.row_number().over(w) - 1).cast("int").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str], integer_columns: Sequence[str] = ()) -> DataFrame:
    """Replace category values by codes; unseen values get the mean code
    of that column (rounded for integer-typed source columns).

    ``codes`` holds one row per distinct value, bounded by the vocabulary;
    it is joined per column (Catalyst broadcasts it when small)."""
    # One scalar per column: safe to bring to the driver as a literal.
    means = {r["column_name"]: r["mean_code"] for r in codes.groupBy("column_name").agg(F.avg("code").alias("mean_code")).collect()}
    out = df
    for c in columns:
        cc = codes.where(F.col("column_name") == c).select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__c_{c}"))
        out = out.join(cc, out[c].cast("string") == cc[f"__v_{c}"], "left")
        m = means.get(c)
        fallback = F.lit(None).cast("double") if m is None else F.lit(float(round(m)) if c in integer_columns else float(m))
        out = out.withColumn(c, F.coalesce(F.col(f"__c_{c}").cast("double"), fallback)).drop(f"__v_{c}", f"__c_{c}")
    return out
