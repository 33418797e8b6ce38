"""Active sample selection.

Per true class, among misclassified rows: margin = p_max - p_true; the two
largest margins are mandatory; the other candidates are thinned to greedy
leaders at ``min_divergence`` (``operators/leaders.py``); the result is capped
at max(2, floor(n_class * 99/100)) in id order.

``thinning="grid"`` keeps one row, the lowest id, per cell of a grid with side
``min_divergence`` over the class's own feature ranges instead: one aggregation
for the ranges and one for the cells, for classes with very many leaders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.functions.columns import MISSING_SENTINEL
from pairbayes.operators import chunks
from pairbayes.operators.leaders import MIN_DIVERGENCE, leaders, leaders_of_chunks

# Fixed values of the selection rule.
MANDATORY_PER_CLASS = 2
MAX_CLASS_ADDITION_PERCENT = 99
STRONG_MARGIN = 0.01
MARGINAL_MARGIN = 0.01


def failed_margins(scored: DataFrame) -> DataFrame:
    """Failed rows with margin = p_max - p_true, the per-class margin
    extremes, strong/marginal flags and the mandatory top-2 flag."""
    f = scored.where(F.col("pred") != F.col("y")).withColumn(
        "margin", F.col("confidence") - F.col("posterior")[F.col("y")]
    )
    # per-class extremes by a group-by (C rows, broadcast), not a class-wide window
    ext = f.groupBy("y").agg(F.max("margin").alias("class_max"), F.min("margin").alias("class_min"))
    f = f.join(F.broadcast(ext), "y")
    f = f.withColumn("strong", F.col("margin") >= F.col("class_max") - F.lit(STRONG_MARGIN)).withColumn(
        "marginal", F.col("margin") <= F.col("class_min") + F.lit(MARGINAL_MARGIN)
    )
    from pairbayes.operators.sampling import rank_within_group

    # margins equal in exact arithmetic can differ in the last bits with the
    # summation order: rank on the margin rounded to 9 decimals, then the id
    r = rank_within_group(f, "y", [F.round("margin", 9).desc(), F.col("row_id")], "margin_rank")
    return r.withColumn("mandatory", F.col("margin_rank") <= MANDATORY_PER_CLASS)


def mandatory_rows(scored: DataFrame) -> DataFrame:
    """The failed rows with the two largest margins of each class (margin to 9
    decimals, then id); Spark keeps two rows a class and task before the shuffle."""
    return largest_margins(failed_by_margin(scored))


def failed_by_margin(scored: DataFrame) -> DataFrame:
    """(row_id, y, margin) of the failed rows, the margin to 9 decimals."""
    margin = F.round(F.col("confidence") - F.col("posterior")[F.col("y")], 9)
    return scored.where(F.col("pred") != F.col("y")).select("row_id", "y", margin.alias("margin"))


def largest_margins(failed: DataFrame) -> DataFrame:
    w = Window.partitionBy("y").orderBy(F.col("margin").desc(), "row_id")
    return failed.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= MANDATORY_PER_CLASS).select("row_id", "y")


def failed_chunks(scored: DataFrame, known: np.ndarray, n_features: int, n_classes: int) -> DataFrame:
    """The failed rows of scored chunks without those whose ids are in the sorted ``known``, as chunks with
    ``margin``, not rounded; ``n_scored`` and ``right`` count all rows of the chunk.  Missing values stand as
    the cleaned tables have them."""
    told = scored.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posterior, right = (batch.column(batch.schema.get_field_index(c)) for c in ("posterior", "right"))
            for k, y, ids, x in chunks.read(batch, n_features):
                p = np.frombuffer(posterior[k].as_buffer()).reshape(-1, n_classes)
                at = np.flatnonzero(p.argmax(axis=1) != y)
                at = at[~chunks.within(ids[at], told.value)]
                margin, own = p[at].max(axis=1, initial=-np.inf) - p[at, y], x[at]
                yield chunks.chunk(y, ids[at], np.where(np.isnan(own), MISSING_SENTINEL, own),
                                   {"margin": (pa.binary(), margin.tobytes()), "n_scored": (pa.int64(), len(ids)), "right": (pa.int64(), right[k].as_py())})

    return scored.select("y", "ids", "x", "posterior", "right").mapInArrow(run, f"{chunks.ABOUT_SQL}, ids binary, x binary, margin binary, n_scored long, right long")


def widest_margins(failed: DataFrame) -> DataFrame:
    """(row_id, y, margin) of the rows of each chunk that can be among the class's ``MANDATORY_PER_CLASS``
    largest margins, the margin to 9 decimals: of equal margins the smallest ids, and all margins that rounding can lift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, margin = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64), np.frombuffer(batch.column(2)[k].as_buffer())
                if not len(ids):
                    continue
                n = max(0, len(margin) - MANDATORY_PER_CLASS)
                least = np.partition(margin, n)[n]  # NaN, the largest to Spark, is last
                at = np.flatnonzero(~(margin < least - 2e-9))
                order = at[np.lexsort((ids[at], margin[at]))]
                start = np.r_[True, margin[order][1:] != margin[order][:-1]]
                place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
                own = order[(place < MANDATORY_PER_CLASS) | np.isnan(margin[order])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(np.full(len(own), batch.column(0)[k].as_py(), np.int32)), pa.array(margin[own])], names=["row_id", "y", "margin"])

    found = failed.where("n > 0").select("y", "ids", "margin").mapInArrow(run, "row_id long, y int, margin double")
    return found.withColumn("margin", F.round("margin", 9))


def grid_leaders(cand: DataFrame, n_features: int, side: float = MIN_DIVERGENCE) -> DataFrame:
    """``(row_id, y)``: the lowest id of every occupied grid cell of ``cand``
    (row_id, y, x).  Cells have ``side`` times the class's range of a feature;
    nulls share a cell of their own."""
    bounds = cand.groupBy("y").agg(F.array(*[F.min(F.col("x")[i]) for i in range(n_features)]).alias("lo"),
                                   F.array(*[F.max(F.col("x")[i]) for i in range(n_features)]).alias("hi"))
    j = cand.join(F.broadcast(bounds), "y")  # one row a class
    place = lambda v, i: F.coalesce(
        F.when(F.col("hi")[i] > F.col("lo")[i], F.floor((v - F.col("lo")[i]) / (F.col("hi")[i] - F.col("lo")[i]) / F.lit(side))).when(v.isNotNull(), 0), F.lit(-1))
    cells = j.select("row_id", "y", F.transform("x", place).alias("cell"))
    return cells.groupBy("y", "cell").agg(F.min("row_id").alias("row_id")).select("row_id", "y")


def select_samples(scored: DataFrame, features: DataFrame, class_sizes: DataFrame, n_features: int,
                   min_divergence: float = MIN_DIVERGENCE, thinning: str = "leaders", pairs=None) -> DataFrame:
    """``(row_id, y)`` rows to add to the training set.

    ``scored``: (row_id, y, posterior, pred, confidence) of candidate rows;
    ``features``: (row_id, x); ``class_sizes``: (y, n) rows per class in the
    scored set (the cap's base).

    ``scored`` can be the chunks of ``failed_chunks`` that a caller keeps, which hold the values of
    the failed rows: ``features`` is not read then, and every id is that of one row."""
    from pairbayes.session import cut_lineage

    if chunks.packed(scored):
        if thinning != "leaders":
            raise ValueError("chunks are thinned to leaders only")
        mandatory = cut_lineage(largest_margins(widest_margins(scored)))
        skip = np.sort(np.array([r["row_id"] for r in mandatory.collect()], np.int64))  # two rows a class
        thin = leaders_of_chunks(scored, n_features, min_divergence, pairs, skip=skip).select("row_id", "y")
        return _capped(mandatory, thin, class_sizes)
    # the rows are scored once: what follows reads the failed ones again
    failed = cut_lineage(failed_by_margin(scored))
    mandatory = cut_lineage(largest_margins(failed))
    # two rows a class
    cand = failed.select("row_id", "y").join(F.broadcast(mandatory.select("row_id")), "row_id", "left_anti").join(features.select("row_id", "x"), "row_id")
    if thinning == "grid":
        thin = grid_leaders(cand, n_features, min_divergence)
    else:
        thin = leaders(cand, n_features, min_divergence, pairs).select("row_id", "y")
    return _capped(mandatory, thin, class_sizes)


def _capped(mandatory: DataFrame, thin: DataFrame, class_sizes: DataFrame) -> DataFrame:
    """Both selections as (row_id, y), each row once, under the cap of its class."""
    from pairbayes.operators.sampling import cap_per_class

    sel = mandatory.select("row_id", F.col("y").cast("int").alias("y")).unionByName(thin.select("row_id", F.col("y").cast("int").alias("y"))).distinct()
    return cap_per_class(sel, "y", "row_id", MAX_CLASS_ADDITION_PERCENT / 100.0, 2, sizes=class_sizes).select("row_id", "y")
