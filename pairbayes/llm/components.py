"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.llm.common import stash


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b long); ``root`` is one node of its component.

    Every node is merged into the first node of its closed neighbourhood, the
    first by id in even rounds (stars vanish at once) and by a hash in odd ones
    (paths shrink by a constant factor), until no edge is left.  Each round is
    a grouping and two joins on a table that is written, so no lineage grows."""
    e = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found, turn = None, 0
    while not e.isEmpty():
        rank = F.xxhash64(F.lit(turn), "b") if turn % 2 else F.col("b")
        own = F.xxhash64(F.lit(turn), "a") if turn % 2 else F.col("a")
        both = e.union(e.select("b", "a")).toDF("a", "b")
        near = both.groupBy("a").agg(F.min(F.struct(rank.alias("r"), F.col("b").alias("b"))).alias("m"))
        step = stash(near.select("a", F.when(own < F.col("m.r"), F.col("a")).otherwise(F.col("m.b")).alias("to")))
        left, right = step.toDF("a", "a2"), step.toDF("b", "b2")
        e = e.join(left, "a").join(right, "b").where("a2 <> b2")
        e = stash(e.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        if found is None:
            found = step.toDF("node", "root")
        else:
            found = found.join(step.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        turn += 1
    return found if found is not None else e.toDF("node", "root")


def stars(linked: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member) for each component of a symmetric boolean matrix."""
    n, out = len(linked), []
    left = np.ones(n, bool)
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        front = linked[i] & left
        while front.any():
            at = np.flatnonzero(front)
            out += [(int(j), i) for j in at]
            left &= ~front
            front = linked[at].any(axis=0) & left
    return out
