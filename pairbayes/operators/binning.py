"""Feature pairs, bin edges and bin assignment."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.functions.columns import all_pair_cells  # noqa: F401  (re-export)

# Fixed values of the reference's edge rule.
PAD_FRACTION = 0.01
MIN_PAD = 1e-6
DEFAULT_BINS = 128
# Up to this many pairs the pair index arrays are plan literals (faster
# than generating them per row); beyond it they are generated per row.
LITERAL_PAIRS_MAX = 50000
# Up to these sizes the per-feature bins and per-pair cells are written as
# one expression each, which whole-stage codegen compiles (about 3x faster
# than the interpreted higher-order functions); larger arrays would exceed
# the generated-method size limit, so they use transform() instead.
CODEGEN_MAX_FEATURES = 256
CODEGEN_MAX_PAIRS = 256


@dataclass(frozen=True)
class BinSpec:
    """Equal-width bins per feature; edges depend only on the feature's min/max."""

    lo: tuple[float, ...]
    width: tuple[float, ...]
    n_bins: int

    @property
    def n_features(self) -> int:
        return len(self.lo)


def pair_order(n_features: int, max_combinations: int | None = None, seed: int = 42) -> tuple[int, int, int]:
    """(how many, step, start) of the pair numbers (step * t + start) mod P, t = 0, 1, ..: all P pairs, or
    a seeded sample of ``max_combinations`` of them without a list.

    The step has no factor in common with P, so no number comes twice; it is below 2^31, so products
    stay in 64 bits."""
    total = n_features * (n_features - 1) // 2
    if max_combinations is None or total <= max_combinations:
        return total, 1, 0
    step = (int(total * 0.6180339887498949) + 2 * seed) % min(total, 2**31 - 1) or 1
    while math.gcd(step, total) != 1:
        step += 1
    return max_combinations, step, (seed * 40503) % total


def feature_pairs(n_features: int, max_combinations: int | None = None, seed: int = 42) -> list[tuple[int, int]]:
    """B1: all sorted 2-combinations; above ``max_combinations`` a seeded,
    deterministic sample (kept in sorted order)."""
    n, step, start = pair_order(n_features, max_combinations, seed)
    total = n_features * (n_features - 1) // 2
    if n == total:
        return list(itertools.combinations(range(n_features), 2))
    return [pair_of(k, n_features) for k in sorted((step * t + start) % total for t in range(n))]


def pair_of(number: int, n_features: int) -> tuple[int, int]:
    """(i, j) of a pair number, by the closed-form inverse of its place in sorted order."""
    wide = 2 * n_features - 1
    i = (wide - math.isqrt(wide * wide - 8 * number)) // 2
    first = lambda i: i * n_features - i * (i + 1) // 2
    i -= first(i) > number
    i += first(i + 1) <= number
    return i, number - first(i) + i + 1


def given_pairs(pairs: Sequence[Sequence[int]]) -> list[tuple[int, int]]:
    """Given feature tuples, each sorted, every one once, in order."""
    return sorted({tuple(sorted(p)) for p in pairs})


def pairs_table(spark, n_features: int, max_combinations: int | None = None, seed: int = 42) -> DataFrame:
    """B1 / W12 as a table (pair_id, f1, f2) made by Spark from pair numbers; ``pair_id`` is the number among all pairs."""
    n, step, start = pair_order(n_features, max_combinations, seed)
    total = n_features * (n_features - 1) // 2
    wide = 2 * n_features - 1
    k = F.col("k")
    first = lambda i: i * n_features - F.floor(i * (i + 1) / 2)
    rows = spark.range(n).select(F.pmod(F.col("id") * step + start, F.lit(total)).alias("k"))
    rows = rows.withColumn("i", F.floor((wide - F.sqrt(F.lit(float(wide) ** 2) - 8 * k)) / 2))
    rows = rows.withColumn("i", F.col("i") - (first(F.col("i")) > k).cast("int"))
    rows = rows.withColumn("i", F.col("i") + (first(F.col("i") + 1) <= k).cast("int"))
    return rows.select(k.cast("int").alias("pair_id"), F.col("i").cast("int").alias("f1"), (k - first(F.col("i")) + F.col("i") + 1).cast("int").alias("f2"))


def edges_from_minmax(mins: Sequence[float], maxs: Sequence[float], n_bins: int) -> BinSpec:
    """B2: pad = max(1% of range, 1e-6); B equal bins on [min-pad, max+pad]."""
    lo, width = [], []
    for mn, mx in zip(mins, maxs):
        if mn is None or mx is None:  # all-null feature: one degenerate bin range
            mn, mx = 0.0, 0.0
        pad = max((mx - mn) * PAD_FRACTION, MIN_PAD)
        a = mn - pad
        b = mx + pad
        lo.append(a)
        width.append((b - a) / n_bins)
    return BinSpec(tuple(lo), tuple(width), n_bins)


def feature_minmax(fx: DataFrame, n_features: int) -> tuple[list[float], list[float]]:
    """A3: one aggregation pass (no shuffle beyond the final single row)."""
    row = fx.agg(*_extremes(n_features)).collect()[0]
    return list(row["mins"]), list(row["maxs"])


def _extremes(n_features: int) -> list:
    """Smallest and largest number of every feature, as two arrays."""
    each = lambda f: ", ".join(f"{f}(CASE WHEN NOT isnan(x[{i}]) THEN x[{i}] END)" for i in range(n_features))
    return [F.expr(f"array({each(f)})").alias(name) for f, name in (("min", "mins"), ("max", "maxs"))]


def fit_bins(fx: DataFrame, n_features: int, n_bins: int = DEFAULT_BINS) -> BinSpec:
    mins, maxs = feature_minmax(fx, n_features)
    return edges_from_minmax(mins, maxs, n_bins)


def double_sql(v: float) -> str:
    """SQL literal with every digit of a double."""
    return f"{float(v)!r}D"


def bin_expr(spec: BinSpec, x: str = "x"):
    """Right-closed bins clamped to 0..B-1; null/NaN -> -1 (missing bin)."""
    B = spec.n_bins
    if spec.n_features <= CODEGEN_MAX_FEATURES:
        # one SQL text: thousands of column calls would take longer than the job
        each = [f"CAST(CASE WHEN `{x}`[{i}] IS NULL OR isnan(`{x}`[{i}]) THEN -1 ELSE greatest(0, least({B - 1}, ceil((`{x}`[{i}] - {double_sql(lo)}) / {double_sql(w)}) - 1)) END AS INT)"
                for i, (lo, w) in enumerate(zip(spec.lo, spec.width))]
        return F.expr(f"array({', '.join(each)})")
    lo_arr = F.lit([float(v) for v in spec.lo])
    w_arr = F.lit([float(v) for v in spec.width])
    return F.transform(
        F.col(x),
        lambda v, i: F.when(v.isNull() | F.isnan(v), F.lit(-1)).otherwise(
            F.greatest(F.lit(0), F.least(F.lit(B - 1), F.ceil((v - lo_arr[i]) / w_arr[i]) - F.lit(1))).cast("int")
        ),
    )


def bin_rows(fx: DataFrame, spec: BinSpec, keep: Sequence[str] = ("row_id", "y")) -> DataFrame:
    """``(keep..., b array<int>)``: the binned row, the unit every later step reuses."""
    return fx.select(*keep, bin_expr(spec).alias("b"))


def pair_struct_array(pairs: Sequence[tuple[int, int]] | None, n_features: int, b: str = "b"):
    """Array of ``struct(bi, bj)`` for each pair, in pair_id order.

    With ``pairs=None`` all pairs are generated by nested ``sequence`` lambdas
    (no literal of size P in the plan); otherwise two literal index arrays."""
    bc = F.col(b)
    n_pairs = n_features * (n_features - 1) // 2 if pairs is None else len(pairs)
    if n_pairs <= CODEGEN_MAX_PAIRS:
        pl = list(itertools.combinations(range(n_features), 2)) if pairs is None else list(pairs)
        return F.array(*[F.struct(bc[int(a)].alias("bi"), bc[int(c)].alias("bj")) for a, c in pl])
    if pairs is None and n_pairs <= LITERAL_PAIRS_MAX:
        pairs = list(itertools.combinations(range(n_features), 2))
    if pairs is None:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(n_features - 2)),
                lambda i: F.transform(
                    F.sequence(i + 1, F.lit(n_features - 1)),
                    lambda j: F.struct(bc[i].alias("bi"), bc[j].alias("bj")),
                ),
            )
        )
    f1 = F.lit([int(a) for a, _ in pairs])
    f2 = F.lit([int(c) for _, c in pairs])
    return F.transform(f1, lambda a, k: F.struct(bc[a].alias("bi"), bc[f2[k]].alias("bj")))


def explode_all_pairs(df: DataFrame, arr: str, n_features: int, keep: Sequence[str],
                      names: tuple[str, str] = ("bi", "bj")) -> DataFrame:
    """All pairs i<j of an array column as rows ``(keep..., pair_id, a, b)``
    in two plain ``posexplode`` steps (i over the array, then j over the
    tail after i), both compiled by whole-stage codegen.  pair_id is the
    position of (i, j) in sorted order: i*F - i*(i+1)/2 + (j - i - 1)."""
    Fn = n_features
    a, b = names
    s1 = df.select(*keep, arr, F.posexplode(F.slice(F.col(arr), 1, Fn - 1)).alias("__i", a))
    s2 = s1.select(*keep, "__i", a, F.posexplode(
        F.slice(F.col(arr), F.col("__i") + 2, F.lit(Fn) - F.col("__i") - 1)).alias("__o", b))
    i = F.col("__i")
    pid = (i * F.lit(Fn) - F.floor(i * (i + 1) / 2) + F.col("__o")).cast("int")
    return s2.select(*keep, pid.alias("pair_id"), a, b)


def explode_cells(binned: DataFrame, pairs: Sequence[tuple[int, int]] | None, n_features: int,
                  keep: Sequence[str] = ("row_id", "y")) -> DataFrame:
    """One row per (row, pair): ``(keep..., pair_id, bi, bj)``.  Generated
    inside the task that read the row: no shuffle."""
    if pairs is None and n_features * (n_features - 1) // 2 > CODEGEN_MAX_PAIRS:
        return explode_all_pairs(binned, "b", n_features, keep)
    return binned.select(*keep, F.posexplode(pair_struct_array(pairs, n_features)).alias("pair_id", "c")).select(
        *keep, F.col("pair_id").cast("int").alias("pair_id"), F.col("c.bi").alias("bi"), F.col("c.bj").alias("bj")
    )


def explode_block(binned: DataFrame, pairs: Sequence[tuple[int, int]] | None, n_features: int, block: tuple[int, int],
                  keep: Sequence[str] = ("row_id", "y")) -> DataFrame:
    """``explode_cells`` for the pairs ``[a, b)`` only."""
    a, b = block
    n = n_features * (n_features - 1) // 2 if pairs is None else len(pairs)
    if (a, b) == (0, n):
        return explode_cells(binned, pairs, n_features, keep)
    every = itertools.combinations(range(n_features), 2) if pairs is None else iter(pairs)
    own = list(itertools.islice(every, a, b))
    ex = explode_cells(binned, own, n_features, keep)
    return ex.withColumn("pair_id", (F.col("pair_id") + F.lit(a)).cast("int"))


def pairs_frame(spark, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """B1 as a table ``(pair_id, f1, f2)`` (size bounded by max_combinations)."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair_id int, f1 int, f2 int")


def edges_frame(fx: DataFrame, n_bins: int = DEFAULT_BINS) -> DataFrame:
    """B2 as a distributed plan: ``(feature, mn, mx, lo, width, hi)``.
    Same arithmetic as ``edges_from_minmax`` (IEEE doubles on both sides)."""
    v = F.col("v")
    g = (
        fx.select(F.posexplode("x").alias("feature", "v"))
        .where(v.isNotNull() & ~F.isnan(v))
        .groupBy(F.col("feature").cast("int").alias("feature"))
        .agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    )
    pad = F.greatest((F.col("mx") - F.col("mn")) * F.lit(PAD_FRACTION), F.lit(MIN_PAD))
    g = g.withColumn("lo", F.col("mn") - pad).withColumn("hi", F.col("mx") + pad)
    return g.withColumn("width", (F.col("hi") - F.col("lo")) / F.lit(float(n_bins)))


def class_profile(fx: DataFrame, n_features: int, label: str = "label"):
    """One pass for everything the driver needs before fitting: sorted class
    list, rows per class and per-feature min/max.  Returns at most C rows of
    2F scalars (bounded by the schema and the class count)."""
    aggs = [F.count(F.lit(1)).alias("__n"), *_extremes(n_features)]
    rows = fx.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("__l")).agg(*aggs).collect()
    rows = sorted(rows, key=lambda r: r["__l"])
    classes = [r["__l"] for r in rows]
    counts = [int(r["__n"]) for r in rows]
    mins, maxs = [], []
    for i in range(n_features):
        lo = [r["mins"][i] for r in rows if r["mins"][i] is not None]
        hi = [r["maxs"][i] for r in rows if r["maxs"][i] is not None]
        mins.append(min(lo) if lo else None)
        maxs.append(max(hi) if hi else None)
    return classes, counts, mins, maxs
