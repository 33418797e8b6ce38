"""Model cells as a lookup in memory (B6, B8): scores and weight changes without a row for each row and pair.

A block of pairs is a broadcast of its occupied cells' values, one row a cell, and a number
of that row for each (pair, bin, bin).  Rows are scored in Arrow batches in the task that
reads them, pair after pair, so what is in memory is a batch and the block, and what leaves
is one row of class sums a row, or one row a changed cell and task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pairbayes.operators.dense import unrank_pairs

#: Rows of a batch that are worked on at once.
STEP = 1 << 14
#: Cells that a counting task holds at most before it hands them over.
MOST_CELLS = 1 << 21


class Cells:
    """Values of the cells of pairs ``[first, first + len(i))``; row 0 stands for all others."""

    def __init__(self, table: pa.Table, first: int, i: np.ndarray, j: np.ndarray, side: int, empty: np.ndarray, dense: bool):
        n, self.first, self.i, self.j, self.side = table.num_rows, first, i, j, side
        col = lambda c: table.column(c).to_numpy().astype(np.int64)
        code = ((col("pair_id") - first) * side + col("bi") + 1) * side + col("bj") + 1
        self.values = np.empty((n + 1, len(empty)))
        self.values[0] = empty
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if dense:
            self.codes, self.at = None, np.zeros(len(i) * side * side, np.int32)
            self.at[code] = np.arange(1, n + 1, dtype=np.int32)
            self.values[1:] = flat.reshape(n, -1)
        else:
            order = np.argsort(code)
            self.codes, self.at = code[order], None
            self.values[1:] = flat.reshape(n, -1)[order]

    def codes_of(self, b: np.ndarray, k: int) -> np.ndarray:
        """Cell codes of rows with bin numbers from 0 (missing) in pair ``k`` of the block."""
        return (k * self.side + b[self.i[k]]) * self.side + b[self.j[k]]

    def rows_of(self, code: np.ndarray) -> np.ndarray:
        if self.at is not None:
            return self.at[code]
        if not len(self.codes):
            return np.zeros(len(code), np.int64)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[place] == code, place + 1, 0)


def block_cells(table: DataFrame, value: str, block: tuple[int, int], pairs, n_features: int, n_bins: int, empty: Sequence[float], limit: int):
    """Broadcast of the ``Cells`` of a block; ``value`` is the array column that is looked up."""
    a, b = block
    if pairs is None:
        i, j = unrank_pairs(np.arange(a, b), n_features)
    else:
        i, j = np.array(list(pairs)[a:b], np.int64).reshape(-1, 2).T
    own = table.where((F.col("pair_id") >= a) & (F.col("pair_id") < b)).select("pair_id", "bi", "bj", F.col(value).alias("v")).toArrow()
    side = n_bins + 1
    return table.sparkSession.sparkContext.broadcast(Cells(own, a, i, j, side, np.array(empty, float), (b - a) * side * side * 4 <= max(limit, 1 << 20)))


def bins_of(col: pa.Array, n_features: int) -> np.ndarray:
    """(feature, row) bin numbers from 0 (missing); a row without bins has none of them."""
    out = np.zeros((len(col), n_features), np.int64)
    out[col.is_valid().to_numpy(zero_copy_only=False)] = col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features) + 1
    return np.ascontiguousarray(out.T)


def class_sums(binned: DataFrame, told, keep: Sequence[str], n_features: int, n_classes: int) -> DataFrame:
    """``binned`` (keep.., b) with ``s``: per class the sum over the block's pairs of the row's cells."""
    kind = binned.select(*keep, "b").schema
    made = StructType([*kind.fields, StructField("s", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = told.value
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                b = bins_of(part.column(len(keep)), n_features)
                s = np.zeros((part.num_rows, n_classes))
                for k in range(len(cells.i)):
                    s += cells.values.take(cells.rows_of(cells.codes_of(b, k)), axis=0)
                offsets = pa.array(np.arange(0, s.size + 1, n_classes, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(s.ravel()))], names=made.names)

    return binned.select(*kind.names).mapInArrow(run, made)


def changed_cells(failed: DataFrame, told, n_features: int, n_classes: int, below: Sequence[float]) -> DataFrame:
    """(y, pair_id, bi, bj, dw): per task the sum of ``adj`` of ``failed`` (y, pred, adj, b) over the cells
    of their class in the block whose value for ``pred`` is under ``below[pred]``."""
    names = ["y", "pair_id", "bi", "bj", "dw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, low = told.value, np.array(below, float)
        side, held = cells.side, {}

        def out() -> Iterator[pa.RecordBatch]:
            for k in sorted(held):
                code, dw = held[k]
                place, y = code // n_classes, code % n_classes
                cols = [y, np.full(len(code), cells.first + k), place // side - 1, place % side - 1]
                yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in cols], pa.array(dw.astype(float))], names=names)
            held.clear()

        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                y, pred, adj = (part.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                b = bins_of(part.column(3), n_features)
                for k in range(len(cells.i)):
                    code = cells.codes_of(b, k)
                    hit = cells.values[cells.rows_of(code), pred] < low[pred]
                    own = (code[hit] - k * side * side) * n_classes + y[hit]
                    got, inverse = np.unique(own, return_inverse=True)
                    dw = np.bincount(inverse, weights=adj[hit], minlength=len(got))
                    if k in held:  # at most the pair's cells of all classes
                        old, before = held[k]
                        both, inverse = np.unique(np.concatenate([old, got]), return_inverse=True)
                        got, dw = both, np.bincount(inverse, weights=np.concatenate([before, dw]), minlength=len(both))
                    held[k] = (got, dw)
                if sum(len(c) for c, _ in held.values()) > 1 << 21:
                    yield from out()
        yield from out()

    rows = failed.select(F.col("y").cast("int").alias("y"), F.col("pred").cast("int").alias("pred"), F.col("adj").cast("double").alias("adj"), "b")
    return rows.mapInArrow(run, "y int, pair_id int, bi int, bj int, dw double")


def task_counts(binned: DataFrame, pairs, n_features: int, n_bins: int, n_classes: int) -> DataFrame:
    """(y, pair_id, bi, bj, n): per task the rows of ``binned`` (y, b) in each cell of each pair; a task
    hands over what it holds where that grows beyond ``MOST_CELLS``, so cells may come several times."""
    given = None if pairs is None else np.array(list(pairs), np.int64).reshape(-1, 2)
    names, side = ["y", "pair_id", "bi", "bj", "n"], n_bins + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = unrank_pairs(np.arange(n_features * (n_features - 1) // 2), n_features) if given is None else given.T
        held: dict[int, tuple] = {}
        ys, bs, n = [], [], 0

        def add() -> None:
            y, b = np.concatenate(ys), np.concatenate(bs, axis=1)
            ys.clear(), bs.clear()
            for k in range(len(i)):
                code = (b[i[k]] * side + b[j[k]]) * n_classes + y
                if side * side * n_classes <= 1 << 16:
                    c = np.bincount(code)
                    got = np.flatnonzero(c)
                    c = c[got]
                else:
                    got, c = np.unique(code, return_counts=True)
                if k in held:
                    old, before = held[k]
                    both, at = np.unique(np.concatenate([old, got]), return_inverse=True)
                    got, c = both, np.bincount(at, weights=np.concatenate([before, c]), minlength=len(both)).astype(np.int64)
                held[k] = (got, c)

        def out() -> Iterator[pa.RecordBatch]:
            for k in sorted(held):
                code, c = held[k]
                place = code // n_classes
                cols = [code % n_classes, np.full(len(code), k), place // side - 1, place % side - 1]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in cols], pa.array(c.astype(np.int64))], names=names)
            held.clear()

        for batch in batches:
            ys.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)), bs.append(bins_of(batch.column(1), n_features))
            n += batch.num_rows
            if n >= STEP:
                add()
                n = 0
                if sum(len(c) for c, _ in held.values()) > MOST_CELLS:
                    yield from out()
        if n:
            add()
        yield from out()

    return binned.select("y", "b").mapInArrow(run, "y int, pair_id int, bi int, bj int, n long")
