"""Scalar and array column expressions.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so the
work stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the results depend on (defaults of the classifier).
MISSING_SENTINEL = -99999.0
LOG_FLOOR = 1e-10
ENTROPY_EPS = 1e-10
STD_EPS = 1e-8

__all__ = [
    "MISSING_SENTINEL",
    "bin_index",
    "bins_array",
    "pair_cells",
    "all_pair_cells",
    "softmax",
    "argmax_first",
    "array_sum",
    "entropy",
    "l2_normalize",
    "row_minmax",
    "row_standardize",
    "safe_name",
    "safe_label",
    "dataset_name",
    "coord_from_name",
    "cosine",
    "dot",
]


def bin_index(x: Column, lo, width, n_bins: int) -> Column:
    """Right-closed equal-width bin: clamp(ceil((x-lo)/width) - 1, 0, B-1).

    Counts the edges strictly below ``x`` (the reference's bucketize) minus one.
    """
    raw = F.ceil((x - lo) / width) - F.lit(1)
    return F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), raw)).cast("int")


def bins_array(x: Column, lo: Sequence[float], width: Sequence[float], n_bins: int) -> Column:
    """Bin every element of array ``x`` with per-position edges (literal arrays)."""
    lo_arr = F.lit([float(v) for v in lo])
    w_arr = F.lit([float(v) for v in width])
    return F.transform(
        x,
        lambda v, i: F.greatest(
            F.lit(0),
            F.least(F.lit(n_bins - 1), F.ceil((v - lo_arr[i]) / w_arr[i]) - F.lit(1)),
        ).cast("int"),
    )


def all_pair_cells(bins: Column, n_features: int, n_bins: int) -> Column:
    """Cell key ``b[i]*B + b[j]`` for every pair i<j, in sorted pair order."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_features - 2)),
            lambda i: F.transform(
                F.sequence(i + 1, F.lit(n_features - 1)),
                lambda j: bins[i] * F.lit(n_bins) + bins[j],
            ),
        )
    )


def pair_cells(bins: Column, pairs: Sequence[tuple[int, int]], n_bins: int) -> Column:
    """Cell key for an explicit list of feature pairs (pair_id = list position)."""
    f1 = F.lit([int(a) for a, _ in pairs])
    f2 = F.lit([int(b) for _, b in pairs])
    return F.transform(f1, lambda a, k: bins[a] * F.lit(n_bins) + bins[f2[k]])


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def softmax(ll: Column, eps: float = LOG_FLOOR) -> Column:
    """exp(ll - max) / (sum + eps), the reference's normalisation."""
    m = F.array_max(ll)
    e = F.transform(ll, lambda v: F.exp(v - m))
    s = array_sum(e)
    return F.transform(e, lambda v: v / (s + F.lit(eps)))


def argmax_first(arr: Column) -> Column:
    """0-based index of the maximum; ties go to the lowest index."""
    return (F.array_position(arr, F.array_max(arr)) - F.lit(1)).cast("int")


def entropy(p: Column, eps: float = ENTROPY_EPS) -> Column:
    """-sum p * ln(p + eps)."""
    return -F.aggregate(p, F.lit(0.0).cast("double"), lambda acc, v: acc + v * F.ln(v + F.lit(eps)))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda u, v: u * v))


def l2_normalize(x: Column) -> Column:
    """x / ||x||; the zero vector is returned unchanged."""
    # a lambda works out all that it names for each element, so the norm is a value of an outer one: once a row
    norms = F.array(F.sqrt(F.aggregate(x, F.lit(0.0).cast("double"), lambda acc, v: acc + v * v)))
    return F.get(F.transform(norms, lambda norm: F.when(norm == 0, F.transform(x, lambda v: v.cast("double"))).otherwise(
        F.transform(x, lambda v: v / norm)
    )), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    na = F.sqrt(dot(a, a))
    nb = F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), na * nb), F.lit(0.0))  # zero vector: 0


def row_minmax(x: Column) -> Column:
    """(x - min)/(max - min) per row; a constant row becomes zeros."""
    lo = F.array_min(x)
    hi = F.array_max(x)
    return F.when(hi == lo, F.transform(x, lambda v: F.lit(0.0))).otherwise(
        F.transform(x, lambda v: (v - lo) / (hi - lo))
    )


def row_standardize(x: Column) -> Column:
    """Per-row (v - mean)/std with population std of the row's own values."""
    n = F.size(x)
    mean = array_sum(x) / n
    var = F.aggregate(x, F.lit(0.0).cast("double"), lambda acc, v: acc + (v - mean) * (v - mean)) / n
    std = F.sqrt(var)
    return F.transform(x, lambda v: (v - mean) / (std + F.lit(STD_EPS)))


def safe_name(s: Column) -> Column:
    """Characters other than word characters, '-' and '.' become '_'."""
    return F.regexp_replace(s, r"[^\w\-.]", "_")


def safe_label(s: Column) -> Column:
    """Non-alphanumeric characters become '_'."""
    return F.regexp_replace(s, r"[^A-Za-z0-9]", "_")


def dataset_name(path: Column) -> Column:
    """Part after ``data/`` (up to the next '/'), else the basename without
    extension; empty -> ``unknown_dataset``."""
    after = F.regexp_extract(path, r"data/([^/]+)", 1)
    base = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    name = F.when(after != "", after).otherwise(base)
    return F.when(name == "", F.lit("unknown_dataset")).otherwise(name)


# Fixed pattern for coordinates inside file names: "<ra>_<dec>" or "<ra>-<dec>".
COORD_PATTERN = r"(-?\d+\.\d+)[_-](-?\d+\.\d+)"


def coord_from_name(name: Column) -> tuple[Column, Column]:
    """(ra, dec) parsed from a file name, rounded to 2 decimals; the last two
    '_' separated parts are the fallback; unparsable -> null."""
    ra1 = F.regexp_extract(name, COORD_PATTERN, 1)
    de1 = F.regexp_extract(name, COORD_PATTERN, 2)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    n = F.size(parts)
    ra2 = F.when(n >= 2, F.element_at(parts, -2))
    de2 = F.when(n >= 2, F.element_at(parts, -1))
    ra = F.when(ra1 != "", ra1).otherwise(ra2).try_cast("double")
    de = F.when(de1 != "", de1).otherwise(de2).try_cast("double")
    return F.bround(ra, 2), F.bround(de, 2)
