"""Exact quantiles of many groups at once (A20, B25) by counting in narrowing ranges.

The value of a rank is sought in a range that is known to hold it: all rows in a group's
ranges are counted in ``BINS`` bins of equal width, with each bin's least and greatest
value; the bin that the rank falls in, cut to those, is the next range.  A range with one
value is the answer, and a range that holds few rows is sorted.  What is shuffled is at
most ``BINS`` counts a range and task, so no group has a state, a sort or a task of its
own, however many rows it has.  The two extreme values of a range always fall in
different bins, so every round narrows it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.session import cut_lineage

BINS = 1024
#: A range with so many rows or fewer is sorted within its key.
FEW = 4096
#: Groups and ranges up to this number are broadcast to the rows; a join by few keys would
#: bring all rows of a key into one task.
TOLD = 100_000


def _told(small: DataFrame) -> DataFrame:
    """``small`` (its lineage cut) for a join, broadcast unless it has very many rows."""
    return F.broadcast(small) if small.limit(TOLD + 1).count() <= TOLD else small


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """(by.., p, q): the quantiles with linear interpolation between neighbouring ranks.

    Null and NaN values do not count; groups without a value have no rows.  Infinite values stand as
    the greatest double.  A null is a group of its own in every ``by`` column."""
    most = 1.7976931348623157e308
    by = list(by)
    v = F.greatest(F.least(F.col(value).cast("double"), F.lit(most)), F.lit(-most))
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], v.alias("v"))
    keys = [f"g{i}" for i in range(len(by))]
    if not by:
        keys, rows = ["g0"], rows.select(F.lit(0).alias("g0"), "v")
    groups = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("gid", F.monotonically_increasing_id()))
    wanted = groups.select("gid", "n", "lo", "hi", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p"))
    at = F.col("p") * (F.col("n") - 1)
    ranks = cut_lineage(wanted.select("gid", "p", F.floor(at).alias("r0"), F.ceil(at).alias("r1"), (at - F.floor(at)).alias("part"), "n", "lo", "hi"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    numbered = rows.join(_told(groups.select(*keys, "gid")), same(rows, groups)).select("gid", "v")

    # (gid, rank, lo, hi, before, m): the rank is the value of number rank - before among the m in [lo, hi]
    both = ranks.select("gid", F.explode(F.array_distinct(F.array("r0", "r1"))).alias("rank"), "lo", "hi", "n").distinct()
    open_ = cut_lineage(both.select("gid", "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("m")))
    found = []
    while True:
        done = open_.where("lo = hi").select("gid", "rank", F.col("lo").alias("v"))
        few = open_.where(f"lo < hi AND m <= {FEW}")
        order = Window.partitionBy("gid", "rank").orderBy("v")
        sorted_ = numbered.join(_told(few), "gid").where("v >= lo AND v <= hi").withColumn("place", F.row_number().over(order) - 1)
        found.append(cut_lineage(done.unionByName(sorted_.where("place = rank - before").select("gid", "rank", "v"))))
        wide = open_.where(f"lo < hi AND m > {FEW}")
        ranges = wide.select("gid", "lo", "hi").distinct()
        if ranges.isEmpty():
            break
        # ranks of one group share their range at first; a range is counted once
        share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        slot = F.when(F.col("v") >= F.col("hi"), BINS - 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        counted = numbered.join(_told(ranges), "gid").where("v >= lo AND v <= hi").groupBy("gid", "lo", "hi", slot.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        upto = Window.partitionBy("gid", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = cut_lineage(counted.withColumn("below", F.coalesce(F.sum("c").over(upto), F.lit(0))))
        next_ = wide.join(counted, ["gid", "lo", "hi"]).where("rank - before >= below AND rank - before < below + c")
        open_ = cut_lineage(next_.select("gid", "rank", F.col("least").alias("lo"), F.col("greatest").alias("hi"), (F.col("before") + F.col("below")).alias("before"), F.col("c").alias("m")))
    values = reduce(DataFrame.unionByName, found)
    low, high = values.toDF("gid", "r0", "v0"), values.toDF("gid", "r1", "v1")
    out = ranks.join(low, ["gid", "r0"]).join(high, ["gid", "r1"]).join(groups.select("gid", *keys), "gid")
    q = F.when(F.col("part") == 0, F.col("v0")).otherwise(F.col("v0") * (1 - F.col("part")) + F.col("v1") * F.col("part"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "p", q.alias("q"))


def wide_quantiles(rows: DataFrame, by: Sequence[str], value: str, ps: Sequence[float], prefix: str) -> DataFrame:
    """One row a group with the columns ``prefix`` + per cent."""
    long = exact_quantiles(rows, by, value, ps)
    name = lambda p: f"{prefix}{int(round(p * 100))}"
    each = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(name(p)) for p in ps]
    return long.groupBy(*by).agg(*each)
