"""Near-duplicate embeddings by products of int8 tiles with rigorous error bounds.

Distinct vectors are scaled to length one and rounded to int8 with a scale of their
own.  With e(x) the exact length of what rounding took from x, the product of two
rounded vectors differs from their cosine by at most

    e(x) * |y| + |x^| * e(y) <= e(x) + (1 + e(x)) * e(y)        (x^ the rounded vector)

plus a few units of floating-point error.  A pair below the threshold by more than this
is no link, one above it by more is; all others, and only those, are computed anew from
the original vectors in double precision.  So no link is lost and none is false.

Vectors are ordered by their nearest of a few seeded pivots and cut into groups of
``GROUP`` rows and tiles of ``TILE``.  A group and a tile know their centre and the
largest angle to it; pairs of them that lie further apart than the threshold's angle
plus both are skipped (angles keep the triangle inequality).  Every other pair of
groups is one cell, which streams the tiles of one group past those of the other.  A
cell returns, for each vector that it links, the number of its links and one edge of a
spanning forest: never pairs.  A group of copies of any size costs products, not rows.

Equal vectors are one node with its number of rows, so copies need no products.

Results on unusual input: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and are kept; vectors of unequal length do not link.  A
repeated row is a row of its own: it links with its copies, and all of them carry the
same class and flag.  The class of a group is its smallest id; rows without an id count
as links, and where a whole group has no id its class is null and the node that is first
by hash is kept.  Extra columns pass through in ``record``; an empty table gives an
empty table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.llm.common import give_back, stash
from pairbayes.llm.components import connected_components

GROUP, TILE, PIVOTS = 8192, 1024, 64
#: Covers the rounding of 32-bit sums of exact int8 products and of scales and norms.
SLACK = 1e-6
MOST_TASKS = 20_000
#: Tiles of a float column carry 4 bytes a component, others 8; both hold the column exactly.
TILE_ROW = "grp long, dims int, n int, centre binary, angle double, nodes binary, codes binary, scales binary, errors binary, copies binary, exact binary"


def usable(vector) -> F.Column:
    """True where a vector can take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (rows of zeros stay); the largest component is divided out first, so
    no square leaves the range."""
    x = x.astype(float)
    most = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(most > 0, most, 1)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the length of the rounding error of unit rows."""
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None])
    error = np.sqrt(((u - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, error


def angle_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between unit rows, from the chord, which is exact for small ones."""
    chord = np.sqrt(((a - b) ** 2).sum(axis=-1))
    return 2 * np.arcsin(np.minimum(1, chord / 2))


def ball(u: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and largest angle of unit rows; pi where they have no mean direction."""
    mean = u.mean(axis=0)
    length = np.sqrt((mean * mean).sum())
    if length < 1e-9:
        return u[0], float(np.pi)
    return mean / length, float(angle_of(u, mean / length).max())


def tiles_of(nodes: np.ndarray, copies: np.ndarray, exact: np.ndarray, group: int) -> dict:
    u = unit(exact)
    codes, scale, error = quantised(u)
    centre, angle = ball(u)
    raw = {"nodes": nodes.astype("<i8"), "codes": codes, "scales": scale.astype("<f8"), "errors": error.astype("<f8"), "copies": copies.astype("<i8"), "exact": exact, "centre": centre.astype("<f8")}
    return {"grp": group, "dims": exact.shape[1], "n": len(nodes), "angle": angle} | {k: np.ascontiguousarray(v).tobytes() for k, v in raw.items()}


class Tile:
    """A tile as a task holds it."""

    def __init__(self, row: dict, kind: str):
        self.dims, self.n, self.angle = row["dims"], row["n"], row["angle"]
        read = lambda name, t: np.frombuffer(row[name], t)
        self.nodes, self.copies = read("nodes", "<i8"), read("copies", "<i8")
        self.centre, self.scale, self.error = read("centre", "<f8"), read("scales", "<f8"), read("errors", "<f8")
        # products of int8 up to 1,000 components are whole numbers below 2^24: a float32 product is exact
        self.codes = read("codes", np.int8).reshape(self.n, self.dims).astype(np.float32 if self.dims <= 1000 else np.float64)
        self.exact = read("exact", kind).reshape(self.n, self.dims)

    def unit(self, rows: np.ndarray) -> np.ndarray:
        return unit(self.exact[rows])


def linked(a: Tile, b: Tile, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of the pairs whose cosine is ``least`` or more."""
    product = a.codes @ b.codes.T
    # the widest bound of the tile pair first: nearly all pairs end here, in one pass
    wide = a.error.max() + (1 + a.error.max()) * b.error.max() + SLACK
    product *= a.scale.astype(np.float32)[:, None]
    product *= b.scale.astype(np.float32)[None, :]
    i, j = np.nonzero(product >= np.float32(least - wide) - np.float32(SLACK))
    if not len(i):
        return i, j
    near = product[i, j].astype(float)
    bound = a.error[i] + (1 + a.error[i]) * b.error[j] + SLACK
    open_ = np.abs(near - least) <= bound
    right = near - least > bound
    at = np.flatnonzero(open_)
    for s in range(0, len(at), 1 << 16):
        part = at[s : s + (1 << 16)]
        right[part] = (a.unit(i[part]) * b.unit(j[part])).sum(axis=1) >= least
    return i[right], j[right]


class Forest:
    """Links of the nodes of a cell: a smallest position and a number of links each."""

    def __init__(self, size: int):
        self.root, self.links = np.arange(size), np.zeros(size, np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                deeper = self.root[self.root]
                if (deeper == self.root).all():
                    break
                self.root = deeper


def nodes_of(rows: DataFrame) -> DataFrame:
    """Distinct vectors: node, vector, number of rows, smallest id."""
    grouped = rows.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"))
    return grouped.select(F.monotonically_increasing_id().alias("node"), "vector", "copies", "least_id")


def with_pivot(rows: DataFrame, seed: int = 23) -> DataFrame:
    """``rows`` with ``near``, the number of the nearest of at most ``PIVOTS`` sampled directions, and
    ``dims``, the length of ``vector``.  It orders rows so that near ones are close; results do not depend on it."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "vector")).limit(PIVOTS).select("vector").collect()
    pivots: dict[int, np.ndarray] = {}
    for d in {len(r["vector"]) for r in sample}:
        pivots[d] = unit(np.array([r["vector"] for r in sample if len(r["vector"]) == d], float))
    told = spark.sparkContext.broadcast(pivots)
    at_vector = rows.columns.index("vector")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, col = np.zeros(batch.num_rows, np.int32), batch.column(at_vector)
            dims = np.diff(col.offsets.to_numpy())
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if int(d) in told.value:
                    x = np.asarray(col.take(pa.array(at)).flatten(), float).reshape(len(at), d)
                    near[at] = (unit(x) @ told.value[int(d)].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(dims.astype(np.int32))], names=[*batch.schema.names, "near", "dims"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(place, f"{fields}, near int, dims int")


def write_tiles(nodes: DataFrame, groups: int, kind: str, seed: int) -> DataFrame:
    """The nodes as written tiles, near ones together; a task's rows are one group."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, wide = TaskContext.get().partitionId(), [], 0
        kinds = pa.schema([("grp", pa.int64()), ("dims", pa.int32()), ("n", pa.int32()), ("centre", pa.binary()), ("angle", pa.float64()), *[(c, pa.binary()) for c in ("nodes", "codes", "scales", "errors", "copies", "exact")]])

        def out() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_pylist([tiles_of(*parts, group)], kinds)

        for batch in batches:
            node, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            dims, col = batch.column(4).to_numpy(), batch.column(1)
            a = 0
            while a < len(node):
                d = int(dims[a])
                if held and (d != wide or sum(len(h[0]) for h in held) >= TILE):
                    yield out()
                    held = []
                wide = d
                same = np.flatnonzero(dims[a:] != d)
                b = min(a + (int(same[0]) if len(same) else len(node) - a), a + TILE - sum(len(h[0]) for h in held))
                x = np.asarray(col.slice(a, b - a).flatten()).astype(kind).reshape(b - a, d)
                held.append((node[a:b], copies[a:b], x))
                a = b
        if held:
            yield out()
        give_back()

    placed = with_pivot(nodes.select("node", "vector", "copies"), seed)
    ordered = placed.repartitionByRange(groups, "dims", "near", F.xxhash64("vector")).sortWithinPartitions("dims", "near", F.xxhash64("vector"))
    return stash(ordered.mapInArrow(pack, TILE_ROW))


def near_groups(tiles: DataFrame, groups: int, least: float) -> DataFrame:
    """Pairs (g, h) of the ``groups`` groups, g <= h, that may hold a link.

    A group's ball is that of its tiles: centre of the first, and the widest of
    (angle to a tile's centre + that tile's angle)."""

    def span(t: pa.Table) -> pa.Table:
        dims = set(t.column("dims").to_pylist())
        centre = [np.frombuffer(c, "<f8") for c in t.column("centre").to_pylist()]
        angle = np.pi if len(dims) > 1 else max(float(angle_of(centre[0], c)) + a for c, a in zip(centre, t.column("angle").to_pylist(), strict=True))
        return pa.table({"grp": t.column("grp").slice(0, 1), "dims": pa.array([-1 if len(dims) > 1 else dims.pop()], pa.int32()), "centre": pa.array([centre[0].tolist()], pa.list_(pa.float64())), "angle": pa.array([angle])})

    spans = stash(tiles.select("grp", "dims", "centre", "angle").groupBy("grp").applyInArrow(span, "grp long, dims int, centre array<double>, angle double"))
    left = spans.toDF("g", "g_dims", "g_centre", "g_angle").withColumn("h", F.explode(F.sequence("g", F.lit(groups - 1).cast("long"))))
    both = left.join(spans.toDF("h", "h_dims", "h_centre", "h_angle"), "h")
    chord = F.sqrt(F.aggregate(F.zip_with("g_centre", "h_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    apart = 2 * F.asin(F.least(F.lit(1.0), chord / 2)) - F.col("g_angle") - F.col("h_angle")
    far = (F.col("g_dims") != F.col("h_dims")) | (apart > float(np.arccos(least)) + SLACK)
    mixed = (F.col("g_dims") < 0) | (F.col("h_dims") < 0)
    return both.where(mixed | ~F.coalesce(far, F.lit(False))).select("g", "h")


def link_cells(tiles: DataFrame, cells: DataFrame, kind: str, least: float) -> DataFrame:
    """(node, links, root) from every cell, for the nodes that it links."""
    reach = float(np.arccos(least)) + SLACK
    own = tiles.join(cells.select(F.col("g").alias("grp"), "g", "h"), "grp").withColumn("side", F.lit(0))
    other = tiles.join(cells.where("g <> h").select(F.col("h").alias("grp"), "g", "h"), "grp").withColumn("side", F.lit(1))
    # a cell or two a task: a task's rows stay small whatever the session's partitions
    dealt = own.unionByName(other).repartition(max(1, min(cells.count(), MOST_TASKS)), "g", "h").sortWithinPartitions("g", "h", "side")

    def search(rows: Iterator[dict]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Streams the rows of the cells; holds one group and one tile."""
        cell, held, forest = None, [], None

        def done():
            nodes = np.concatenate([t.nodes for t, _ in held] + [n for n in passed])
            at = np.flatnonzero(forest.links)
            return nodes[at], forest.links[at], nodes[forest.root[at]]

        def meet(a: Tile, at: int, b: Tile, bt: int) -> None:
            if a.dims != b.dims or angle_of(a.centre, b.centre) - a.angle - b.angle > reach:
                return
            i, j = linked(a, b, least)
            if a is b:
                i, j = i[i < j], j[i < j]
            if len(i):
                forest.links[at : at + a.n] += np.bincount(i, b.copies[j], a.n).astype(np.int64)
                forest.links[bt : bt + b.n] += np.bincount(j, a.copies[i], b.n).astype(np.int64)
                forest.add(at + i, bt + j)

        passed: list[np.ndarray] = []
        for row in rows:
            if (row["g"], row["h"]) != cell:
                if cell is not None:
                    yield done()
                cell, held, passed, forest = (row["g"], row["h"]), [], [], Forest(0)
            t, at = Tile(row, kind), len(forest.root)
            forest.root = np.concatenate([forest.root, np.arange(at, at + t.n)])
            forest.links = np.concatenate([forest.links, np.zeros(t.n, np.int64)])
            within = cell[0] == cell[1]
            if within or row["side"] == 1:
                for a, a_at in held:
                    meet(a, a_at, t, at)
            if row["side"] == 0:
                held.append((t, at))
                if within:
                    meet(t, at, t, at)
            else:
                passed.append(t.nodes)
        if cell is not None:
            yield done()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
        for node, links, root in search(rows):
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], names=["node", "links", "root"])
        give_back()

    return dealt.mapInArrow(run, "node long, links long, root long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, seed: int = 23) -> DataFrame:
    """One row for each row: ``record`` (a struct of all columns), ``id``, ``n_links``, ``component_id``, ``kept``."""
    if not 0 < least <= 1:
        raise ValueError("the threshold is a cosine above 0 and up to 1")
    narrow = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if narrow else "<f8"
    vector = F.col(f"`{vector_col}`").cast("array<float>" if narrow else "array<double>")
    # adding 0 makes -0.0 and 0.0 one value, so that equal vectors are one group
    even = F.transform(vector, lambda x: x + F.lit(0).cast("float" if narrow else "double"))
    all_rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("record"), F.col(f"`{id_col}`").cast("long").alias("id"), F.when(usable(vector), even).alias("vector"))
    nodes = stash(nodes_of(all_rows.where("vector is not null").select("id", "vector")))
    n = nodes.count()
    if n:
        groups = -(-n // GROUP)
        tiles = write_tiles(nodes, groups, kind, seed)
        found = stash(link_cells(tiles, stash(near_groups(tiles, groups, least)), kind, least))
    else:
        found = rows.sparkSession.createDataFrame([], "node long, links long, root long")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hashed = F.struct(F.xxhash64("vector").alias("h"), F.col("node"))
    classes = told.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min(hashed)["node"].alias("first"))
    told = told.join(classes, "root").select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", (F.col("node") == F.col("first")).alias("first"))
    out = all_rows.join(told, "vector", "left")
    alone = F.col("vector").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    kept = F.when(alone, True).when(F.col("component_id").isNull(), F.col("first")).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.select("record", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
