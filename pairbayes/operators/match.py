"""Matching and voting.

No operator here builds an unrestricted cross product: tolerance matches join
distinct vectors on buckets of as many coordinates as they need, nearest-point search walks an
adaptive quadtree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.functions.columns import l2_normalize
from pairbayes.operators import quadtree
from pairbayes.session import cut_lineage

# Fixed tolerances of the spectrum match (numpy allclose defaults, atol 1e-5).
ATOL = 1e-5
RTOL = 1e-5


# Group sizes: a group of a key is compared pair by pair up to so many pairs, else cut again;
# what no coordinate parts is compared in blocks of so many rows.
GROUP_PAIRS = 1 << 18
BLOCK_ROWS = 512


def tolerance_nodes(rows: DataFrame, label: str, vector: str, normalize: bool = True) -> DataFrame:
    """(node, label, v, n): the distinct (label, vector) of ``rows`` with their number of rows; vectors
    are L2-normalised where asked.  Rows without a label or vector are no node."""
    v = l2_normalize(F.col(vector)) if normalize else F.col(vector).cast("array<double>")
    g = rows.select(F.col(label).alias("label"), v.alias("v")).where("label IS NOT NULL AND v IS NOT NULL").groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(g.select(F.monotonically_increasing_id().alias("node"), "label", "v", "n"))


def tolerance_links(s: DataFrame, p: DataFrame, atol: float = ATOL, rtol: float = RTOL, normalize: bool = True) -> DataFrame:
    """(s_node, p_node): pairs of nodes of one label and length with |s - p| <= atol + rtol*|p| in every
    element.

    Keys are buckets of single coordinates.  Normalised values are <= 1 in magnitude, so buckets as wide
    as atol + rtol are enough; others are bucketed on the scale sign(p) * ln(1 + |p|), on which the
    tolerance moves a value by less than 2 * (atol + rtol).  A source stands in its bucket and both
    neighbours, so a pair meets in exactly one group.  The coordinate with most buckets comes first;
    groups of more than GROUP_PAIRS pairs are parted by the next one, and so on.  What all coordinates
    leave together is compared in blocks."""
    width = (atol + rtol) * (1.000001 if normalize else 2.0)
    place = lambda v: F.floor((v if normalize else F.signum(v) * F.log1p(F.abs(v))) / F.lit(width))
    one = p.agg(F.max(F.size("v")).alias("f")).first()["f"] or 0
    if not one:
        return s.sparkSession.createDataFrame([], "s_node long, p_node long")
    scale = "get(v, {i})" if normalize else "signum(get(v, {i})) * log1p(abs(get(v, {i})))"
    each = ", ".join(f"approx_count_distinct(floor({scale.format(i=i)} / {width!r}D))" for i in range(one))
    spread = p.agg(F.expr(f"array({each})").alias("n")).first()["n"]
    order = sorted(range(one), key=lambda i: (-spread[i], i))
    ok = F.forall(F.zip_with("v", "w", lambda a, b: F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)), lambda x: x)
    key = F.concat_ws("|", F.col("label").cast("string"), F.size("v"))
    left, right, found = s.select("node", "label", "v", key.alias("key")), p.select("node", "label", "v", key.alias("key")), []
    for i in order:
        left = left.withColumn("b", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: place(F.get("v", F.lit(i))) + d))).where("b IS NOT NULL")
        left = left.withColumn("key", F.concat_ws("|", "key", "b")).drop("b")
        right = right.withColumn("b", place(F.get("v", F.lit(i)))).where("b IS NOT NULL").withColumn("key", F.concat_ws("|", "key", "b")).drop("b")
        sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(right.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key")
        large = cut_lineage(sizes.where(F.col("n") * F.col("m") > GROUP_PAIRS).select("key"))
        rest = not large.isEmpty()
        if rest:
            left, right = cut_lineage(left), cut_lineage(right)
        small = left.join(large, "key", "left_anti") if rest else left
        met = small.select("key", "label", "v", F.col("node").alias("s_node")).join(right.select("key", F.col("label").alias("p_label"), F.col("v").alias("w"), F.col("node").alias("p_node")), "key")
        met = met.where((F.col("label") == F.col("p_label")) & (F.size("v") == F.size("w")) & ok).select("s_node", "p_node")
        if not rest:
            found.append(met)
            break
        found.append(cut_lineage(met))
        left, right = left.join(large, "key", "left_semi"), right.join(large, "key", "left_semi")
    else:
        found.append(_block_links(left, right, atol, rtol))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _block_links(left: DataFrame, right: DataFrame, atol: float, rtol: float) -> DataFrame:
    """Links within keys of very many nodes that agree in all buckets: blocks against blocks."""

    def pack(batches):
        for batch in batches:
            keys, nodes, v = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            at: dict[str, list[int]] = {}
            for i, k in enumerate(keys):
                at.setdefault(k, []).append(i)
            for k, own in at.items():
                for a in range(0, len(own), BLOCK_ROWS):
                    part = own[a : a + BLOCK_ROWS]
                    yield pa.RecordBatch.from_pylist([{"key": k, "nodes": [nodes[i] for i in part], "x": np.array(v.take(pa.array(part)).to_pylist(), float).tobytes()}], pa.schema([("key", pa.string()), ("nodes", pa.list_(pa.int64())), ("x", pa.binary())]))

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[x]).reshape(len(row[n]), -1) for x, n in (("x", "nodes"), ("y", "others")))
                near = np.ones((len(a), len(b)), bool)
                for i in range(a.shape[1]):
                    near &= np.abs(a[:, i, None] - b[None, :, i]) <= atol + rtol * np.abs(b[None, :, i])
                i, j = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(row["nodes"], np.int64)[i]), pa.array(np.array(row["others"], np.int64)[j])], names=["s_node", "p_node"])

    packs = [side.select("key", "node", "v").mapInArrow(pack, "key string, nodes array<bigint>, x binary") for side in (left, right)]
    both = packs[0].join(packs[1].toDF("key", "others", "y"), "key").select("nodes", "x", "others", "y")
    return cut_lineage(both.mapInArrow(compare, "s_node long, p_node long"))


def _membership(rows: DataFrame, nodes: DataFrame, label: str, vector: str, normalize: bool, name: str) -> DataFrame:
    """``rows`` with the number of their node in the column ``name``."""
    v = l2_normalize(F.col(vector)) if normalize else F.col(vector).cast("array<double>")
    return rows.withColumn("__v", v).join(nodes.select(F.col("label").alias("__l"), F.col("v").alias("__n"), F.col("node").alias(name)), (F.col(label) == F.col("__l")) & (F.col("__v") == F.col("__n"))).drop("__v", "__l", "__n")


def tolerance_join_cols(sources: DataFrame, preds: DataFrame, label: str, svec: str, pvec: str,
                        atol: float = ATOL, rtol: float = RTOL, normalize: bool = True) -> DataFrame:
    """Pairs (source, prediction) with the same label whose (L2-normalised)
    vectors satisfy |s - p| <= atol + rtol*|p| element-wise (numpy allclose).

    Links are found between distinct vectors; the pairs of rows are their
    members.  To count or vote, use ``tolerance_vote``, which makes no pairs."""
    s, p = tolerance_nodes(sources, label, svec, normalize), tolerance_nodes(preds, label, pvec, normalize)
    links = tolerance_links(s, p, atol, rtol, normalize)
    left = _membership(sources, s, label, svec, normalize, "s_node")
    right = _membership(preds, p, label, pvec, normalize, "p_node")
    return left.join(links, "s_node").join(right.drop(label), "p_node").drop("s_node", "p_node")


def tolerance_vote(sources: DataFrame, preds: DataFrame, label: str, svec: str, pvec: str, group: str, vote: str, order: str,
                   atol: float = ATOL, rtol: float = RTOL, normalize: bool = True) -> DataFrame:
    """J3 + A14: the majority value per source group over its matches, from counts of equal vectors:
    (group, winner, total, winner_votes, winner_share), as ``majority_vote`` of the pairs gives."""
    s, p = tolerance_nodes(sources, label, svec, normalize), tolerance_nodes(preds, label, pvec, normalize)
    links = tolerance_links(s, p, atol, rtol, normalize)
    own = _membership(sources, s, label, svec, normalize, "s_node").groupBy("s_node", group).agg(F.count(F.lit(1)).alias("__m"))
    cast = _membership(preds, p, label, pvec, normalize, "p_node").groupBy("p_node", vote).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    # per source node first: its groups may be as many as its rows
    by_node = links.join(cast, "p_node").groupBy("s_node", vote).agg(F.sum("__n").alias("__n"), F.min("__first").alias("__first"))
    g = own.join(by_node, "s_node").groupBy(group, vote).agg(F.sum(F.col("__m") * F.col("__n")).alias("votes"), F.min("__first").alias("__first"))
    return _winners(g, group, vote)


def majority_vote(matches: DataFrame, group: str, vote: str, order: str) -> DataFrame:
    """Per group the winning value (most votes; ties -> the value met
    first in ``order``), total votes, winner votes and winner share."""
    return _winners(matches.groupBy(group, vote).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("__first")), group, vote)


def _winners(g: DataFrame, group: str, vote: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col("votes").desc(), F.col("__first"))
    r = g.withColumn("__rn", F.row_number().over(w)).withColumn("total", F.sum("votes").over(Window.partitionBy(group)))
    return r.where(F.col("__rn") == 1).select(
        group, F.col(vote).alias("winner"), "total", F.col("votes").alias("winner_votes"),
        (F.col("votes") / F.col("total")).alias("winner_share"),
    )


def nearest_point(queries: DataFrame, points: DataFrame, qid: str, qx: str, qy: str,
                  pid: str, px: str, py: str, cell: float | None = None, leaf: int = quadtree.LEAF) -> DataFrame:
    """For every query the nearest point by flat Euclidean distance; ties
    go to the smallest point id (name).

    Points in one place are one point (only the smallest id can win) and equal
    queries are searched once; the search walks down an adaptive quadtree
    (``operators/quadtree.py``).  Points without finite coordinates take no
    part; a query without them, or without any point, keeps its row with nulls.
    ``cell`` is accepted from earlier callers: the tree sizes its cells itself."""
    pts = points.where(quadtree.finite(px) & quadtree.finite(py)).groupBy(F.col(px).cast("double").alias("px"), F.col(py).cast("double").alias("py")).agg(F.min(pid).alias("pid"))
    pts = cut_lineage(pts)
    asked = queries.select(F.col(qid).alias("__qid"), F.col(qx).cast("double").alias("qx"), F.col(qy).cast("double").alias("qy"))
    if pts.isEmpty():
        none = F.lit(None).cast(points.schema[pid].dataType)
        return asked.select(F.col("__qid").alias(qid), none.alias(pid), F.lit(None).cast("double").alias("distance"))
    places = cut_lineage(asked.where(quadtree.finite("qx") & quadtree.finite("qy")).select("qx", "qy").distinct())
    found = quadtree.search(places, *quadtree.build(pts, leaf))
    return asked.join(found, ["qx", "qy"], "left").select(F.col("__qid").alias(qid), F.col("pid").alias(pid), F.sqrt("d2").alias("distance"))
