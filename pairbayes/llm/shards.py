"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records uniformly into buckets of about ``bucket_bytes``
by a seeded hash of all their columns.  Pass two shuffles each bucket with
Spark's ``shuffle`` function (Fisher-Yates over the bucket's records, seeded)
and lays the buckets end to end; record p of that order goes to shard p mod n,
slot p div n.  Bucket offsets come from counts per bucket, never from the
records.

The records of a bucket are put in hash order first and the rows of a task in
bucket order, so that a task run again after a lost executor draws the same
permutation.  Nulls take part like any value; equal rows share a bucket and
each keeps a slot of its own.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 8 << 20


def bucket_total(df: DataFrame, bytes_of, bucket_bytes: int) -> int:
    total = df.agg(F.sum(bytes_of)).first()[0] or 0
    return max(1, -(-int(total) // bucket_bytes))


def shuffle_shards(df: DataFrame, n_shards: int, bytes_of, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``df`` as ``record`` (a struct of its columns) with ``shard`` and ``slot``.

    ``bytes_of`` is the size expression that sets the number of buckets."""
    n = bucket_total(df, bytes_of, bucket_bytes)
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), hashed.alias("h"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(n)).cast("long"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    buckets = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("h", "record"))).alias("records"))
    # a local sort, no exchange: the generator draws for one bucket after the other
    buckets = buckets.join(offsets, "bucket").sortWithinPartitions("bucket")
    drawn = buckets.select("base", F.shuffle("records", F.lit(seed)).alias("records"))
    placed = drawn.select("base", F.posexplode("records").alias("pos", "r"))
    place = F.col("base") + F.col("pos")
    return placed.select("r.record", F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """Write the shuffled records, one folder a shard, in slot order."""
    rows = placed.select("record.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    chunk = F.floor(F.col("_slot") / 100_000)
    rows.repartition("_shard", chunk).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
