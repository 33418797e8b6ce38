"""Stencils on images by tiles with a halo.

A pixel table is cut into square tiles; a pixel near an edge goes to the neighbouring
tiles as well, so each tile has all that its own pixels' neighbourhoods need.  A tile is
one bounded array, all shifts of a stencil are views of it, and only its own pixels give
results.  A large image is many tasks, and the side of the tiles changes no result.

Absent pixels and null or NaN values are one thing: there is no value there."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 256
# Fixed set of co-occurrence directions: angle -> step (rows, columns).
ANGLES = {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1)}
# Co-occurrence matrices of so many times so many tiles are merged before those of an image.
BLOCK = 4
KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
MATRIX = ["angle", "code_type", "codes", "count_type", "counts"]


class Tile:
    """The pixels of a tile as an array with a rim of ``halo``."""

    def __init__(self, t: pa.Table, side: int, halo: int):
        self.image, self.halo = t.column("image_id")[0], halo
        ty, tx = t.column("ty")[0].as_py(), t.column("tx")[0].as_py()
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        wide = side + 2 * halo
        self.a = np.full((wide, wide), np.nan)
        at = y - ty * side + halo, x - tx * side + halo
        self.a[at] = t.column("v").to_numpy(zero_copy_only=False).astype(float)
        own = (at[0] >= halo) & (at[0] < halo + side) & (at[1] >= halo) & (at[1] < halo + side)
        self.rows, self.cols, self.y, self.x = at[0][own], at[1][own], y[own], x[own]

    def own(self, a: np.ndarray) -> np.ndarray:
        """Values of the tile's own pixels, in the order of ``y`` and ``x``."""
        return a[self.rows, self.cols]


def beside(a: np.ndarray, axis: int, there: np.ndarray, mirror: bool) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours before and after along an axis.  Where there is none the pixel itself stands, or with
    ``mirror`` the one on the other side, if there is one."""
    before, after = np.roll(a, 1, axis), np.roll(a, -1, axis)
    has_before, has_after = np.roll(there, 1, axis), np.roll(there, -1, axis)
    far_before, far_after = (np.where(has_after, after, a), np.where(has_before, before, a)) if mirror else (a, a)
    return np.where(has_before, before, far_before), np.where(has_after, after, far_after)


def nine(a: np.ndarray, mirror: bool = False) -> list[list[np.ndarray]]:
    """The 3 x 3 neighbourhood: first along each row, then of whole rows along each column."""
    there = ~np.isnan(a)
    w, e = beside(a, 1, there, mirror)
    cols = [beside(v, 0, there, mirror) for v in (w, a, e)]
    return [[c[0] for c in cols], [w, a, e], [c[1] for c in cols]]


def by_tile(pix: DataFrame, v: str, halo: int, work: Callable[[Tile], dict[str, np.ndarray]], schema: str, side: int | None = None) -> DataFrame:
    """``work`` on every tile: its columns, with ``image_id`` in front (``schema`` without it)."""
    side = side or SIDE
    if side <= halo:
        raise ValueError("a tile is wider than its halo")
    kind = pix.schema["image_id"].dataType.simpleString()
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))
    cut = pix.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(v).cast("double").alias("v"))
    cut = cut.where("y IS NOT NULL AND x IS NOT NULL").withColumn("ty", reach("y")).withColumn("tx", reach("x"))

    def run(t: pa.Table) -> pa.Table:
        tile = Tile(t, side, halo)
        cols = work(tile) if len(tile.rows) else {}
        n = len(next(iter(cols.values()))) if cols else 0
        image = pa.array([tile.image.as_py()] * n, t.schema.field("image_id").type)
        if not cols:
            return pa.table({"image_id": image} | {c.split()[0]: pa.array([], KINDS[c.split()[1]]) for c in schema.split(", ")})
        return pa.table({"image_id": image} | {c.split()[0]: pa.array(cols[c.split()[0]], KINDS[c.split()[1]], from_pandas=True) for c in schema.split(", ")})

    return cut.groupBy("image_id", "ty", "tx").applyInArrow(run, f"image_id {kind}, {schema}")


def laplacian_sums(pix: DataFrame, v: str, side: int | None = None) -> DataFrame:
    """(image_id, rows, n, s, ss) of the 4-neighbour Laplacian, mirrored at the border."""

    def work(t: Tile) -> dict:
        up, mid, down = nine(t.a, mirror=True)
        lap = t.own(up[1] + down[1] + mid[0] + mid[2] - 4 * mid[1])
        lap = lap[~np.isnan(lap)]
        return {"rows": np.array([len(t.rows)]), "n": np.array([len(lap)]), "s": np.array([lap.sum()]), "ss": np.array([(lap * lap).sum()])}

    parts = by_tile(pix, v, 1, work, "rows long, n long, s double, ss double", side)
    return parts.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "s", "ss")])


def sobel_sums(pix: DataFrame, v: str, side: int | None = None) -> DataFrame:
    """(image_id, rows, n, s): sum of the Sobel gradient's length."""

    def work(t: Tile) -> dict:
        up, mid, down = nine(t.a)
        gy = (down[0] + 2 * down[1] + down[2]) - (up[0] + 2 * up[1] + up[2])
        gx = (up[2] + 2 * mid[2] + down[2]) - (up[0] + 2 * mid[0] + down[0])
        g = t.own(np.sqrt(gx * gx + gy * gy))
        g = g[~np.isnan(t.own(t.a))]  # the gradient does not use the pixel itself
        return {"rows": np.array([len(t.rows)]), "n": np.array([len(g)]), "s": np.array([g.sum()])}

    parts = by_tile(pix, v, 1, work, "rows long, n long, s double", side)
    return parts.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "s")])


def medians(pix: DataFrame, v: str, side: int | None = None) -> DataFrame:
    """(image_id, val, med): every pixel with the median of its 3 x 3 neighbourhood."""

    def work(t: Tile) -> dict:
        around = np.stack([t.own(c) for row in nine(t.a) for c in row])
        return {"val": t.own(t.a), "med": np.sort(around, axis=0)[4]}

    return by_tile(pix, v, 1, work, "val double, med double", side)


def box_means(pix: DataFrame, v: str, k: int, side: int | None = None) -> DataFrame:
    """(image_id, y, x, box_mean) of the pixels whose whole (2k+1)-box has values."""

    def work(t: Tile) -> dict:
        mean = t.a
        for axis in (1, 0):  # sums along each row, then along each column; a gap makes them NaN
            mean = sum(np.roll(mean, s, axis) for s in range(-k, k + 1)) / (2 * k + 1)
        box = t.own(mean)
        full = ~np.isnan(box)
        return {"y": t.y[full], "x": t.x[full], "box_mean": box[full]}

    return by_tile(pix, v, k, work, "y long, x long, box_mean double", side)


def _small(a: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them: its name and the bytes."""
    kind = np.result_type(np.min_scalar_type(a.min()), np.min_scalar_type(a.max())).newbyteorder("<")
    return kind.str, a.astype(kind).tobytes()


def _merged(batches: Iterable[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """angle -> (codes, counts) of all rows; holds one matrix and one batch at a time."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        parts: dict[int, list] = {}
        for r in batch.select(MATRIX).to_pylist():
            parts.setdefault(r["angle"], []).append((np.frombuffer(r["codes"], r["code_type"]).astype(np.int64), np.frombuffer(r["counts"], r["count_type"]).astype(np.int64)))
        for angle, new in parts.items():
            new += [held[angle]] if angle in held else []
            if len(new) == 1:
                held[angle] = new[0]
                continue
            codes, at = np.unique(np.concatenate([c for c, _ in new]), return_inverse=True)
            counts = np.zeros(len(codes), np.int64)
            np.add.at(counts, at, np.concatenate([n for _, n in new]))
            held[angle] = codes, counts
    return held


def cooccurrence(pix: DataFrame, q: str, levels: int, work: Callable[[int, np.ndarray, np.ndarray, np.ndarray], dict], schema: str,
                 distance: int = 1, side: int | None = None) -> DataFrame:
    """``work(angle, i, j, c)`` on every image's matrix of an angle, a row each: how often (c) grey level i
    has j a step away; both orders count.

    A tile sends a row for each angle, the matrix as bytes; tiles are merged by blocks, blocks by image."""
    columns = [*MATRIX, "by", "bx"]

    def count(t: Tile) -> dict:
        out: dict[str, list] = {c: [] for c in columns}
        here = t.own(t.a)
        for angle, (dy, dx) in ANGLES.items():
            there = t.a[t.rows + dy * distance, t.cols + dx * distance]
            both = ~np.isnan(here) & ~np.isnan(there)
            if not both.any():
                continue
            i, j = here[both].astype(np.int64), there[both].astype(np.int64)
            codes, n = np.unique(np.concatenate([i * levels + j, j * levels + i]), return_counts=True)
            place = (t.y[0] // (side or SIDE) // BLOCK, t.x[0] // (side or SIDE) // BLOCK)
            for c, v in zip(columns, (angle, *_small(codes), *_small(n), *place), strict=True):
                out[c].append(v)
        return out

    kind = pix.schema["image_id"].dataType.simpleString()
    packed = "angle int, code_type string, codes binary, count_type string, counts binary"
    parts = by_tile(pix, q, distance, count, f"{packed}, by long, bx long", side)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        for angle, (codes, n) in _merged(chain([first], batches)).items():
            yield pa.RecordBatch.from_arrays([first.column("image_id")[:1], pa.array([angle], pa.int32()), *[pa.array([v]) for v in (*_small(codes), *_small(n))]], names=["image_id", *MATRIX])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        rows = [work(angle, codes // levels, codes % levels, n) for angle, (codes, n) in _merged(chain([first], batches)).items()]
        image = pa.array([first.column("image_id")[0].as_py()] * len(rows), first.schema.field("image_id").type)
        yield pa.RecordBatch.from_arrays([image, *[pa.array([r[c] for r in rows], pa.float64()) for c in (x.split()[0] for x in schema.split(", "))]], names=["image_id", *[x.split()[0] for x in schema.split(", ")]])

    blocks = parts.groupBy("image_id", "by", "bx").applyInArrow(merge, f"image_id {kind}, {packed}")
    return blocks.groupBy("image_id").applyInArrow(finish, f"image_id {kind}, {schema}")
