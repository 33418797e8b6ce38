"""Nearest points (J4) by an adaptive quadtree of counted cells.

The points' square is a frame, cut into cells so fine that a cell of evenly spread points
holds at most ``LEAF`` of them.  A cell that holds more is a frame of its own, laid tightly
around its points and cut by its own count, and so on: a dense place becomes many small
leaves however small it is beside the rest, and no leaf is large.  Every cell above the
leaves knows the exact box of its points.  Queries walk down the tree step by step: a cell
that holds points has one within the far corner of its box, so cells whose box starts
beyond the nearest such corner are left.  What is left at the end is compared point by
point.

Boxes are made of the points' own coordinates and rounding keeps order, so no bound needs
a margin and ties are all seen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.session import cut_lineage

LEAF = 64
#: A step down parts a cell in 2^STEP times 2^STEP.
STEP = 2
CELL = ["f", "d", "cx", "cy"]
BOX = [("px", F.min, "x0"), ("px", F.max, "x1"), ("py", F.min, "y0"), ("py", F.max, "y1")]


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _place(c: str, lo: str) -> Column:
    """Number of the cell along one side; halves keep the difference of far numbers finite."""
    half = F.greatest(F.col("x1") / 2 - F.col("x0") / 2, F.col("y1") / 2 - F.col("y0") / 2)
    wide = F.pow(F.lit(2.0), STEP * F.col("d"))
    part = F.try_divide(F.col(c) / 2 - F.col(lo) / 2, half)
    return F.least(F.floor(F.coalesce(part, F.lit(0.0)) * wide), wide - 1).cast("long")


def build(points: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(points with the cell of their leaf, nodes) of ``points`` (px, py, pid), distinct in place.

    A node is (f, d, cx, cy, is_leaf, into, x0, x1, y0, y1): frame, depth in it, cell, and the frame
    that the cell is itself, if it is one."""
    depth = F.greatest(F.lit(1), F.ceil(F.log(F.col("n") / leaf) / math.log(4**STEP))).cast("int")
    box = [f(c).alias(name) for c, f, name in BOX]
    frames = points.agg(F.count(F.lit(1)).alias("n"), *box).select(F.lit("0").alias("f"), depth.alias("d"), "x0", "x1", "y0", "y1")
    open_, done, cells, turn = points.select("px", "py", "pid", F.lit("0").alias("f")), [], [], 0
    while True:
        turn += 1
        laid = cut_lineage(open_.join(frames, "f").select("px", "py", "pid", "f", "d", _place("px", "x0").alias("cx"), _place("py", "y0").alias("cy")))
        counted = laid.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), *box)
        counted = cut_lineage(counted.withColumn("into", F.when(F.col("n") > leaf, F.concat(F.lit(f"{turn}-"), F.monotonically_increasing_id()))))
        cells.append(counted)
        both = laid.join(counted.where("into IS NOT NULL").select(*CELL, "into"), CELL, "left")  # of two written tables
        done.append(both.where("into IS NULL").drop("into"))
        full = counted.where("into IS NOT NULL")
        if full.isEmpty():
            break
        frames = full.select(F.col("into").alias("f"), depth.alias("d"), "x0", "x1", "y0", "y1")
        open_ = both.where("into IS NOT NULL").select("px", "py", "pid", F.col("into").alias("f"))
    held, every = done[0], cells[0]
    for part, more in zip(done[1:], cells[1:]):
        held, every = held.unionByName(part), every.unionByName(more)
    # the cell that a frame is made of stands for the frame's depth 0
    up = lambda c: F.call_function("shiftright", F.col(c), (STEP * (F.col("d") - F.col("k"))).cast("int"))
    own = F.col("k") == F.col("d")
    above = every.withColumn("k", F.explode(F.sequence(F.when(F.col("f") == "0", 0).otherwise(1), F.col("d"))))
    above = above.select("f", F.col("k").alias("d"), up("cx").alias("cx"), up("cy").alias("cy"), (own & F.col("into").isNull()).alias("is_leaf"), F.when(own, F.col("into")).alias("into"), "x0", "x1", "y0", "y1")
    nodes = above.groupBy(*CELL).agg(F.max("is_leaf").alias("is_leaf"), F.max("into").alias("into"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return held, cut_lineage(nodes)


def _square(x: Column, y: Column) -> Column:
    return x * x + y * y


def search(queries: DataFrame, held: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qx, qy, d2, pid): the nearest point of every distinct place (qx, qy), ties to the smallest pid."""
    place = ["qx", "qy"]
    gap = lambda q, lo, hi: F.greatest(F.col(lo) - F.col(q), F.col(q) - F.col(hi), F.lit(0.0))
    reach = lambda q, lo, hi: F.greatest(F.abs(F.col(q) - F.col(lo)), F.abs(F.col(hi) - F.col(q)))
    bound = Window.partitionBy(*place)
    wide = range(1 << STEP)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in wide for j in wide])
    front = queries.select(*place, F.lit(float("inf")).alias("u"), F.lit("0").alias("f"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    found, k = [], 0
    while True:
        # all queries meet in the top cells, which every task can hold; cells of other frames come further down
        level = nodes.where((F.col("f") == "0") & (F.col("d") == k))
        near = front.join(F.broadcast(level) if k <= 1 else nodes, CELL)
        near = near.withColumns({"lo": _square(gap("qx", "x0", "x1"), gap("qy", "y0", "y1")), "hi": _square(reach("qx", "x0", "x1"), reach("qy", "y0", "y1"))})
        near = cut_lineage(near.withColumn("u", F.least("u", F.min("hi").over(bound))).where("lo <= u").select(*place, "u", *CELL, "is_leaf", "into", "lo"))
        found.append(near.where("is_leaf").select(*place, "u", "lo", *CELL))
        inner = near.where("NOT is_leaf")
        if inner.isEmpty():
            break
        below = inner.withColumn("s", F.explode(steps))
        fresh = F.col("into").isNotNull()
        child = lambda c, s: F.when(fresh, F.col(s)).otherwise(F.shiftleft(c, STEP) + F.col(s)).cast("long")
        front = below.select(*place, "u", F.coalesce("into", "f").alias("f"), F.when(fresh, 1).otherwise(F.col("d") + 1).alias("d"), child("cx", "s.i").alias("cx"), child("cy", "s.j").alias("cy"))
        k += 1
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs.withColumn("u", F.min("u").over(bound)).where("lo <= u")
    met = pairs.join(held, CELL).select(*place, _square(F.col("px") - F.col("qx"), F.col("py") - F.col("qy")).alias("d2"), "pid")
    return met.groupBy(*place).agg(F.min(F.struct("d2", "pid")).alias("b")).select(*place, "b.d2", "b.pid")
