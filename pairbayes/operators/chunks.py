"""Rows as chunks: the ids, values and bins of up to ``CHUNK_ROWS`` rows of a class as binary columns.

A pass over a table that is kept this way hands a task arrays, not rows, so it costs what
numpy needs.  Every chunk holds one class in id order and tells how many rows it holds, its
first and last id and the sums of its values; what these rule out is not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.operators.binning import BinSpec

CHUNK_ROWS = 1 << 13
#: Rows that a task holds at most, of all classes, before it hands over what it has.
HELD_ROWS = 1 << 18

ABOUT = ["y", "n", "first", "last", "total"]
ABOUT_SQL = "y int, n int, first long, last long, total array<double>"
ABOUT_ARROW = [("y", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("total", pa.list_(pa.float64()))]


def packed(df: DataFrame) -> bool:
    """True for chunks, False for plain rows."""
    return {"first", "last", "ids", "x"} <= set(df.columns)


def chunk(y: int, ids: np.ndarray, x: np.ndarray, more: dict[str, tuple[pa.DataType, object]] | None = None) -> pa.RecordBatch:
    """One chunk of rows that are in id order, with further columns."""
    about = [[y], [len(ids)], [int(ids[0]) if len(ids) else None], [int(ids[-1]) if len(ids) else None], [x.sum(axis=0)]]
    cols = [pa.array(v, kind) for v, (_, kind) in zip(about, ABOUT_ARROW)]
    cols += [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (ids, x)]
    more = more or {}
    return pa.RecordBatch.from_arrays([*cols, *[pa.array([v], kind) for kind, v in more.values()]], names=[*ABOUT, "ids", "x", *more])


def bins(x: np.ndarray, spec: BinSpec) -> np.ndarray:
    """(feature, row) bin numbers from 0 (missing): ``binning.bin_expr`` plus one, the same double arithmetic."""
    with np.errstate(invalid="ignore", over="ignore"):
        b = np.clip(np.nan_to_num(np.ceil((x - np.array(spec.lo)) / np.array(spec.width)) - 1, nan=-1.0), 0, spec.n_bins - 1)
    return np.ascontiguousarray(np.where(np.isnan(x), 0, b + 1).astype("<u2").T)


def matrix(col: pa.Array, n_features: int) -> np.ndarray:
    """Values of an array column, one row a row; missing values and rows without values are NaN."""
    if not col.null_count:
        return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
    out = np.full((len(col), n_features), np.nan)
    out[col.is_valid().to_numpy(zero_copy_only=False)] = col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
    return out


def pack(rows: DataFrame, n_features: int, spec: BinSpec | None = None) -> DataFrame:
    """Chunks of ``rows`` (row_id, y, x) that have a class, with their bins ``b`` where a ``spec`` is given."""
    if spec is not None and spec.n_bins >= (1 << 16) - 1:
        raise ValueError("up to 65,534 bins a feature")
    size, most = CHUNK_ROWS, HELD_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def out(c: int) -> Iterator[pa.RecordBatch]:
            ids, x = (np.concatenate(v) for v in zip(*held.pop(c)))
            del count[c]
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for a in range(0, len(ids), size):
                i, v = ids[a : a + size], x[a : a + size]
                yield chunk(c, i, v, None if spec is None else {"b": (pa.binary(), bins(v, spec).tobytes())})

        for batch in batches:
            ids, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), n_features)
            for c in np.unique(y).tolist():
                at = np.flatnonzero(y == c)
                held.setdefault(c, []).append((ids[at], x[at]))
                count[c] = count.get(c, 0) + len(at)
                if count[c] >= size:
                    yield from out(c)
            if sum(count.values()) > most:
                for c in list(held):
                    yield from out(c)
        for c in list(held):
            yield from out(c)

    own = rows.where("y IS NOT NULL").select(F.col("row_id").cast("long").alias("row_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("array<double>").alias("x"))
    return own.mapInArrow(run, f"{ABOUT_SQL}, ids binary, x binary" + (", b binary" if spec is not None else ""))


def read(batch: pa.RecordBatch, n_features: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(place, class, ids, x) of the chunks of a batch."""
    y, ids, x = (batch.column(batch.schema.get_field_index(c)) for c in ("y", "ids", "x"))
    for k in range(batch.num_rows):
        yield k, y[k].as_py(), np.frombuffer(ids[k].as_buffer(), np.int64), np.frombuffer(x[k].as_buffer()).reshape(-1, n_features)


def within(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``ids`` are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(ids), bool)
    return known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids


def rows_of(chunks: DataFrame, ids: np.ndarray, n_features: int) -> DataFrame:
    """(row_id, y, x) of the rows with the sorted ``ids``; missing values are null."""
    told = chunks.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, y, own, x in read(batch, n_features):
                at = np.flatnonzero(within(own, told.value))
                if len(at):
                    yield rows(y, own[at], x[at])

    return chunks.select("y", "ids", "x").mapInArrow(run, "row_id long, y int, x array<double>")


def unpack(chunks: DataFrame, n_features: int) -> DataFrame:
    """(row_id, y, x) of all rows; missing values are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, y, ids, x in read(batch, n_features):
                yield rows(y, ids, x)

    return chunks.select("y", "ids", "x").mapInArrow(run, "row_id long, y int, x array<double>")


def rows(y: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
    values = pa.array(np.ascontiguousarray(x).ravel(), mask=np.isnan(x).ravel())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), y, np.int32)), pa.ListArray.from_arrays(offsets, values)], names=["row_id", "y", "x"])


def first_rows(chunks: DataFrame, per_chunk: int) -> DataFrame:
    """(row_id, y): the smallest ids of each chunk, so the smallest of each class are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)[:per_chunk]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), batch.column(0)[k].as_py(), np.int32))], names=["row_id", "y"])

    return chunks.select("y", "ids").mapInArrow(run, "row_id long, y int")
