"""Spectrum text parsing and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_spectrum(text: Column, drop_first: bool = True, length: int | None = 94) -> Column:
    """``"[dc p1 ... pn]"`` -> array<double>; brackets and newlines
    stripped, split on blanks, element 0 (DC) dropped; rows whose values do
    not all parse, or whose length differs from ``length``, give null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\[|\]$", ""), r"[\r\n]+", " "))
    parts = F.filter(F.split(t, r"\s+"), lambda s: s != "")
    vals = F.transform(parts, lambda s: s.try_cast("double"))
    ok = F.forall(vals, lambda v: v.isNotNull())
    if drop_first:
        vals = F.slice(vals, 2, F.greatest(F.size(vals) - 1, F.lit(0)))
    good = ok & (F.size(vals) == F.lit(length)) if length is not None else ok
    return F.when(good, vals)


def spectrum_text(vec: Column, dc: Column | None = None) -> Column:
    """Inverse of ``parse_spectrum`` (the file form: bracketed, blank separated)."""
    arr = vec.cast("array<double>")
    if dc is not None:
        arr = F.concat(F.array(dc.cast("double")), arr)
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda v: v.cast("string")), " "), F.lit("]"))


def to_columns(df: DataFrame, vec: str, n: int, prefix: str = "Power_", keep=()) -> DataFrame:
    """Array -> ``Power_1..Power_n`` columns."""
    return df.select(*keep, *[F.col(vec)[i].alias(f"{prefix}{i + 1}") for i in range(n)])


def mean_std_by_position(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Per label and position the mean and population std."""
    e = df.select(label, F.posexplode(vec).alias("pos", "v"))
    return e.groupBy(label, "pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
