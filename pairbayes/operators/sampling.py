"""Seed rows, per-class caps, deterministic splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lehmer (MINSTD) step: exact in 64-bit integers on any engine.
_M = 2147483647
_A = 48271


def split_unit(row_id: Column, seed: int = 42) -> Column:
    """A deterministic pseudo-uniform value in [0, 1) from an integer id:
    three Lehmer steps (products stay below 2^47, exact in 64-bit ints)."""
    r = F.pmod(row_id + F.lit(seed), F.lit(_M))
    for _ in range(3):
        r = F.pmod(r * F.lit(_A), F.lit(_M))
    return r / F.lit(float(_M))


def split_unit_sql(col: str, seed: int = 42) -> str:
    """The same value as SQL text (for oracles)."""
    r = f"(({col} + {seed}) % {_M})"
    for _ in range(3):
        r = f"(({r} * {_A}) % {_M})"
    return f"({r} / {float(_M)}e0)".replace(".0e0", ".0")


def train_test_split(df: DataFrame, row_id: str = "row_id", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` = 'train'/'test' by a seeded hash of the id; no shuffle,
    no driver state, stable under re-partitioning and executor loss."""
    return df.withColumn("split", F.when(split_unit(F.col(row_id), seed) < F.lit(1.0 - test_share), "train").otherwise("test"))


def seeded_sample(df: DataFrame, n: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """N rows ordered by a seeded hash (the limit *is* the feature here)."""
    return df.orderBy(split_unit(F.col(row_id), seed), F.col(row_id)).limit(n)


def seed_rows(df: DataFrame, per_class: int = 2, label: str = "y", order: str = "row_id") -> DataFrame:
    """The first ``per_class`` rows of every class by id."""
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_class).drop("__rn")


def cap_per_class(df: DataFrame, label: str = "y", order: str = "row_id", share: float = 0.99, floor: int = 2,
                  sizes: DataFrame | None = None) -> DataFrame:
    """Keep max(floor, int(n_class * share)) rows per class in id order.
    Class sizes come from a group-by (C rows, broadcast) and the rank from
    ``rank_within_group``, so no task holds a whole class."""
    sizes = sizes if sizes is not None else df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    cap = sizes.select(label, F.greatest(F.lit(floor), F.floor(F.col("n") * F.lit(share))).alias("__cap"))
    r = rank_within_group(df, label, [order], "__rn")
    return r.join(F.broadcast(cap), label).where(F.col("__rn") <= F.col("__cap")).drop("__rn", "__cap")


def global_index(df: DataFrame, order: list[str], name: str = "index", partitions: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Dense 0-based position in the global order of ``order``, all
    JVM-side.  Range-partition + sort within partitions, checkpoint (so the
    sampled range bounds cannot change between the two passes), count rows
    per partition (one row per partition to the driver), then
    index = rows in earlier partitions + position inside the partition.
    Columns that are not in ``keep`` are left out of the checkpoint."""
    from pairbayes.session import cut_lineage

    spark = df.sparkSession
    n = partitions or max(1, spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())  # follows the input's bytes
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    s = (s if keep is None else s.select(*keep)).withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    s = cut_lineage(s)
    cnt = {r["__pid"]: r["c"] for r in s.groupBy("__pid").agg(F.count(F.lit(1)).alias("c")).collect()}
    offs, acc = {}, 0
    for pid in sorted(cnt):
        offs[pid] = acc
        acc += cnt[pid]
    off_arr = F.lit([int(offs.get(i, 0)) for i in range(max(cnt) + 1 if cnt else 1)])
    pos = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return s.withColumn(name, (off_arr[F.col("__pid")] + pos).cast("long")).drop("__pid", "__mid")


def rank_within_group(df: DataFrame, group: str, order: list, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Exact 1-based rank inside each group without a per-group window.

    A window partitioned by the group puts a whole group into one task; with
    one group holding a third of all rows that task would sort a third of
    the data.  Here rows are range-partitioned on (group, order) -- a hot
    group spreads over many partitions -- sorted within partitions and
    checkpointed; per (group, partition) row counts (a small table) give
    each partition's offset inside its group, and rank = offset + position."""
    from pairbayes.session import cut_lineage

    spark = df.sparkSession
    n = partitions or max(1, spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())  # follows the input's bytes
    keys = [F.col(group)] + [F.col(o) if isinstance(o, str) else o for o in order]
    s = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    s = s.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    s = cut_lineage(s)
    first = s.groupBy(group, "__pid").agg(F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (group, partition): at most groups x partitions rows
    first = first.withColumn("__off", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    j = s.join(F.broadcast(first.select(group, "__pid", "__first", "__off")), [group, "__pid"])
    return j.withColumn(name, (F.col("__off") + F.col("__mid") - F.col("__first") + 1).cast("long")).drop(
        "__pid", "__mid", "__first", "__off")
