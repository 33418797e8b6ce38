"""Threshold-scaled document sketches, with DataFrame functions only.

A document's fingerprint is the sorted set of the hashes of its word shingles
that lie below a fixed fraction of the hash range.  Because the threshold is
the same for all documents, sketches of parts merge by set union, and the
share of a sketch found in another one estimates containment however unequal
the documents are.

A text with fewer words than a shingle is one shingle; a text of which no hash
lies below the threshold keeps its smallest one.  Null, empty and blank texts
have an empty fingerprint; two empty fingerprints are alike (1.0), an empty one
is unlike any other (0.0).  Extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.llm.common import word_array

SHINGLE, FRACTION = 5, 0.125


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hash of every run of ``size`` words; ``words`` must be a plain column."""
    at = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[words[i + k] for k in range(size)]))
    return F.when(F.size(words) >= size, at).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def below(hashes: Column, fraction: float = FRACTION) -> Column:
    limit = min(int(-(2**63) + fraction * 2**64), 2**63 - 1)
    return F.filter(hashes, lambda h: h < F.lit(limit))


def kept(hashes: Column, low: Column) -> Column:
    """The sketch: sorted distinct hashes below the threshold (``low``), or else the smallest hash."""
    return F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.sort_array(F.array_distinct(low)))


def merged(one: Column, other: Column) -> Column:
    """Sketch of two parts put together (without the shingles across the seam)."""
    return F.array_sort(F.array_union(one, other))


def fingerprint(sketch: Column) -> Column:
    return F.concat_ws(",", F.transform(sketch, lambda h: F.lower(F.hex(h))))


def containment(one: Column, other: Column) -> Column:
    """Share of the smaller sketch that the other holds, 0 to 1."""
    least = F.least(F.size(one), F.size(other))
    both = (F.size(one) == 0) & (F.size(other) == 0)
    return F.when(both, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(one, other)) / least).cast("double")


def sketched(df: DataFrame, text_cols: dict[str, str], size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Add the sketch of each text column: ``text_cols`` maps it to the new column's name."""
    # one projection a step, so that each array is built once
    out, at = df, {c: f"_{i}" for i, c in enumerate(text_cols)}
    out = out.withColumns({f"_w{i}": word_array(F.lower(c)) for c, i in at.items()})
    out = out.withColumns({f"_h{i}": shingle_hashes(F.col(f"_w{i}"), size) for i in at.values()})
    out = out.withColumns({f"_l{i}": below(F.col(f"_h{i}"), fraction) for i in at.values()})
    out = out.withColumns({text_cols[c]: kept(F.col(f"_h{i}"), F.col(f"_l{i}")) for c, i in at.items()})
    return out.drop(*[f"_{k}{i}" for k in "whl" for i in at.values()])


def with_next(df: DataFrame, prepare=lambda d: d, carry: tuple[str, ...] = ("text",), id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 2048, most_buckets: int = 200_000) -> DataFrame:
    """``prepare(df)`` with ``next_<c>`` for each column of ``carry``: its value in the row
    that follows in descending id order, in the first row after the last.  Nulls come
    last, equal ids by a hash of their texts.

    Ids are dealt into ranges of about ``rows_per_bucket`` rows, so the rows are
    shuffled once and no task orders the whole table; the last row of a range
    takes the first row of the next range, which is found through ids alone and
    prepared apart.  There are at most ``most_buckets`` ranges (larger ones beyond
    that), so the list of their first ids is bounded and may be broadcast."""
    lo, hi, n = df.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    rows_per_bucket = max(rows_per_bucket, -(-n // most_buckets))
    width = max(1.0, (float(hi) - float(lo) + 1) * rows_per_bucket / n) if n else 1.0
    bucket = F.coalesce(F.floor((F.col(id_col) - F.lit(lo if n else 0)) / F.lit(width)), F.lit(-1)).cast("long")
    rows = df.withColumns({"_b": bucket, "_h": F.xxhash64(text_col), "_i": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))})
    own = F.struct(*carry)
    led = prepare(rows).withColumn("_t", F.lead(own).over(Window.partitionBy("_b").orderBy(F.col(id_col).desc_nulls_last(), F.col("_h").desc())))

    tops = rows.groupBy("_b").agg(F.max(F.struct("_i", "_h")).alias("top"))
    down = Window.orderBy(F.col("_b").desc())
    first = F.first("top").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ahead = tops.select(F.col("_b").alias("_at"), F.coalesce(F.lead("top").over(down), first).alias("top")).select("_at", "top.*")
    firsts = prepare(rows.join(F.broadcast(ahead), ["_i", "_h"])).groupBy("_at").agg(F.first(own).alias("_f"))
    out = led.join(firsts, led["_b"] == firsts["_at"], "left").withColumn("_n", F.coalesce("_t", "_f"))
    return out.withColumns({f"next_{c}": F.col(f"_n.{c}") for c in carry}).drop("_b", "_h", "_i", "_t", "_f", "_n", "_at")
