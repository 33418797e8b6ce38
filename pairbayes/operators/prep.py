"""Cleaning and scaling of feature tables (P1-P14) and profiles.

Statistics are computed by one aggregation each and applied as literals
(one scalar per column: bounded by the schema, not the data)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.functions.columns import MISSING_SENTINEL
from pairbayes.operators.quantiles import wide_quantiles

# Fixed values of the preparation rules.
CARDINALITY_THRESHOLD = 0.9
ROUND_DECIMALS = 4
STD_FLOOR = 1e-8


def null_sentinel(df: DataFrame, cols: Sequence[str], sentinel: float = MISSING_SENTINEL) -> DataFrame:
    """``coalesce(col, sentinel)`` plus a ``<col>_missing`` mask column."""
    out = df
    for c in cols:
        out = out.withColumn(f"{c}_missing", F.col(c).isNull()).withColumn(
            c, F.coalesce(F.col(c).cast("double"), F.lit(float(sentinel)))
        )
    return out


def numeric_if_possible(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adopt ``try_cast(double)`` for a text column only when no non-null
    value turns null (all-or-nothing, like pandas' errors='ignore')."""
    aggs = [F.sum(F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), 1).otherwise(0)).alias(c)
            for c in cols]
    bad = df.agg(*aggs).collect()[0].asDict()
    out = df
    for c in cols:
        if bad[c] == 0:
            out = out.withColumn(c, F.col(c).try_cast("double"))
    return out


def round_features(df: DataFrame, cols: Sequence[str], decimals: int = ROUND_DECIMALS) -> DataFrame:
    """Half-to-even rounding (numpy's rule); ``decimals=-1`` disables."""
    if decimals < 0:
        return df
    out = df
    for c in cols:
        out = out.withColumn(c, F.bround(F.col(c), decimals))
    return out


def cardinality(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct count and distinct/rows ratio per column in one scan.  Exact: the
    values of a row go out as (column, value) pairs, are made distinct (per task
    before the shuffle), and are counted by column.  ``approx=True`` uses
    HyperLogLog (no shuffle of values at scale)."""
    if approx:
        aggs = [F.count(F.lit(1)).alias("__n")] + [F.approx_count_distinct(F.col(c)).alias(c) for c in cols]
        stack = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in cols)
        long = df.agg(*aggs).selectExpr("__n AS n_rows", f"stack({len(cols)}, {stack}) AS (column_name, n_distinct)")
    else:
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
        pairs = df.select(F.explode(F.array_append(pairs, F.struct(F.lit("").alias("column_name"), F.lit(None).cast("string").alias("value")))).alias("p"))
        n = pairs.groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("n"))
        n = n.groupBy("column_name").agg(F.count("value").alias("n_distinct"), F.sum("n").alias("n_rows"))
        names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")  # an empty table has no pairs
        long = names.join(n, "column_name", "left").select("column_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
    return long.withColumn("ratio", F.try_divide("n_distinct", "n_rows"))


def high_cardinality_report(df: DataFrame, cols: Sequence[str], threshold: float = CARDINALITY_THRESHOLD,
                            approx: bool = False) -> DataFrame:
    """``(column_name, n_distinct, ratio, kept)``; a column is dropped when
    ratio > threshold; if every column would go, all are kept."""
    r = cardinality(df, cols, approx)
    any_kept = F.max(F.when(F.col("ratio") <= threshold, 1).otherwise(0)).over(Window.partitionBy())
    return r.withColumn("kept", (F.col("ratio") <= threshold) | (any_kept == 0)).drop("n_rows")


def drop_high_cardinality(df: DataFrame, cols: Sequence[str], threshold: float = CARDINALITY_THRESHOLD,
                          approx: bool = False) -> tuple[DataFrame, list[str]]:
    rep = high_cardinality_report(df, cols, threshold, approx).collect()  # one row per column
    keep = [r["column_name"] for r in rep if r["kept"]]
    drop = [c for c in cols if c not in keep]
    return df.drop(*drop), keep


def adaptive_cardinality_report(df: DataFrame, cols: Sequence[str], threshold: float = CARDINALITY_THRESHOLD) -> DataFrame:
    """P5: threshold' = min(t, max(2*median ratio, 0.1)); keep ratio <= t'; only
    when every column would go, the max(2, 20%) columns with the lowest ratios stay."""
    r = cardinality(df, cols)
    n = len(cols)
    min_keep = max(2, int(0.2 * n))
    w = Window.partitionBy()
    med = F.percentile(F.col("ratio"), 0.5).over(w)
    t2 = F.least(F.lit(threshold), F.greatest(F.lit(2.0) * med, F.lit(0.1)))
    rank = F.row_number().over(Window.orderBy("ratio", "column_name"))
    return r.withColumn("threshold", t2).withColumn("rank", rank).withColumn(
        "kept", (F.col("ratio") <= F.col("threshold"))
        | ((F.min("ratio").over(w) > F.col("threshold")) & (F.col("rank") <= min_keep))
    ).drop("n_rows")


def categorical_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """String columns, or numeric with distinct < min(50, 5% of rows)."""
    types = dict(df.dtypes)
    r = cardinality(df, cols)
    is_text = F.col("column_name").isin([c for c in cols if types[c] == "string"])
    lim = F.least(F.lit(50.0), F.col("n_rows") * F.lit(0.05))
    return r.withColumn("categorical", is_text | (F.col("n_distinct") < lim)).drop("n_rows")


def column_stats(df: DataFrame, cols: Sequence[str], sample_std: bool = True) -> DataFrame:
    """``(column_name, mean, std)`` with std 0 -> 1; sample (n-1) or
    population std.  Uses the numerically stable built-ins, not sums of squares."""
    sd = F.stddev_samp if sample_std else F.stddev_pop
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), sd(c).alias(f"s_{c}")]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `m_{c}`, `s_{c}`" for c in cols)
    long = row.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, mean, std)")
    return long.withColumn("std", F.when(F.col("std").isNull() | (F.col("std") == 0), F.lit(1.0)).otherwise(F.col("std")))


def zscore(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None, sample_std: bool = True) -> DataFrame:
    """(x - mean)/std with frozen statistics (one scalar pair per column)."""
    stats = stats if stats is not None else column_stats(df, cols, sample_std)
    st = {r["column_name"]: (r["mean"], r["std"]) for r in stats.collect()}
    out = df
    for c in cols:
        m, s = st[c]
        out = out.withColumn(c, (F.col(c) - F.lit(m)) / F.lit(s))
    return out


def channel_stats(pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Per channel mean, sample std, min, max, count over all pixels, in one scan."""
    names = ("mean", "std", "min", "max", "n")
    fns = (F.avg, F.stddev_samp, F.min, F.max, F.count)
    row = pixels.agg(*[f(c).alias(f"{c}_{k}") for c in channels for k, f in zip(names, fns)])
    stack = ", ".join(f"'{c}', " + ", ".join(f"`{c}_{k}`" for k in names) for c in channels)
    return row.selectExpr(f"stack({len(channels)}, {stack}) AS (channel, {', '.join(names)})")


def normalise(df: DataFrame, cols: Sequence[str], stats: dict[str, tuple[float, float]], eps: float = STD_FLOOR) -> DataFrame:
    """P10: (x - m)/(s + 1e-8) with frozen stats."""
    out = df
    for c in cols:
        m, s = stats[c]
        out = out.withColumn(c, (F.col(c) - F.lit(m)) / (F.lit(s) + F.lit(eps)))
    return out


def denormalise(df: DataFrame, cols: Sequence[str], stats: dict[str, tuple[float, float]]) -> DataFrame:
    """P10 inverse: x*s + m."""
    out = df
    for c in cols:
        m, s = stats[c]
        out = out.withColumn(c, F.col(c) * F.lit(s) + F.lit(m))
    return out


def minmax_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column min, max and range (zero range -> 1)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', CAST(`lo_{c}` AS DOUBLE), CAST(`hi_{c}` AS DOUBLE)" for c in cols)
    long = row.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, lo, hi)")
    rng = F.col("hi") - F.col("lo")
    return long.withColumn("range", F.when(rng == 0, F.lit(1.0)).otherwise(rng))


def minmax_scale(df: DataFrame, cols: Sequence[str], bounds: DataFrame | None = None) -> DataFrame:
    b = {r["column_name"]: (r["lo"], r["range"]) for r in (bounds if bounds is not None else minmax_bounds(df, cols)).collect()}
    out = df
    for c in cols:
        lo, rg = b[c]
        out = out.withColumn(c, (F.col(c) - F.lit(lo)) / F.lit(rg))
    return out


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """A1: per class n and percentage of all rows."""
    g = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


def inverse_frequency_weights(df: DataFrame, label: str) -> DataFrame:
    """A2: 1/(n + 1e-8), scaled so the weights sum to the class count."""
    g = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    w = F.lit(1.0) / (F.col("n") + F.lit(1e-8))
    all_ = Window.partitionBy()
    return g.withColumn("raw", w).withColumn(
        "weight", F.col("raw") / F.sum("raw").over(all_) * F.count(F.lit(1)).over(all_)
    ).drop("raw")


def percentiles(df: DataFrame, col: str, ps: Sequence[float], by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Exact linear-interpolation percentiles (numpy default) by counting in narrowing ranges,
    or ``percentile_approx``."""
    if approx:
        agg = [F.percentile_approx(col, p, 10000).alias(f"p{int(round(p * 100))}") for p in ps]
        return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
    return wide_quantiles(df, by, col, ps, "p")


def pair_cardinality(df: DataFrame, group: str, n_features: int) -> DataFrame:
    """(group, cardinality), the sum over the pairs of ``x`` of their distinct values in each group.

    One scan: a row gives one row a pair, equal ones meet in one aggregation.  A pair with a null in it
    does not count."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("x")[i].alias("a"), F.col("x")[j].alias("b"))
                      for i in range(n_features) for j in range(i + 1, n_features)])
    each = df.select(group, F.explode(pairs).alias("p")).where("p.a IS NOT NULL AND p.b IS NOT NULL").distinct()
    counted = each.groupBy(group).agg(F.count(F.lit(1)).alias("cardinality"))
    return df.select(group).distinct().join(counted, group, "left").select(group, F.coalesce("cardinality", F.lit(0)).alias("cardinality"))


def cardinality_threshold_report(card: DataFrame, threshold: float = CARDINALITY_THRESHOLD) -> DataFrame:
    """min/max/mean/median/p90 of ratios and the share below threshold."""
    return card.agg(
        F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"), F.avg("ratio").alias("mean_ratio"),
        F.percentile(F.col("ratio"), 0.5).alias("median_ratio"), F.percentile(F.col("ratio"), 0.9).alias("p90_ratio"),
        F.avg(F.when(F.col("ratio") <= threshold, 1.0).otherwise(0.0)).alias("share_below"),
    )
