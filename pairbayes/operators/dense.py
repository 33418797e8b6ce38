"""Dense pair histograms (A4, B4): counts of all classes of a block of pairs in one task.

Binned rows are packed once into chunks of small integers, and each chunk goes to every
block of pairs.  A task holds one dense count block, (pair, bin, bin, class), adds chunk
after chunk by ``bincount`` over packed cells, and returns its occupied cells: what
leaves it are counts, never one row for each row and pair.  The block is bounded by
``BLOCK_BYTES`` whatever the number of rows, pairs or classes; a pair too large for it is
counted sparsely, chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.operators.binning import BinSpec

BLOCK_BYTES = 32 << 20
CHUNK_ROWS = 16_384
# Rows that one task adds up; beyond, tasks share a block and their counts are summed.
GROUP_ROWS = 1 << 20


def unrank_pairs(ids: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of pair numbers in sorted order: the closed-form inverse of
    i*F - i*(i+1)/2 + (j - i - 1), put right by one step where the root is rounded."""
    k = np.asarray(ids, np.int64)
    wide = 2 * n_features - 1
    i = ((wide - np.sqrt(np.maximum(float(wide) ** 2 - 8.0 * k, 0))) / 2).astype(np.int64)
    first = lambda i: i * n_features - i * (i + 1) // 2
    i -= first(i) > k
    i += first(i + 1) <= k
    return i, k - first(i) + i + 1


def bin_numbers(x: np.ndarray, spec: BinSpec) -> np.ndarray:
    """``binning.bin_expr`` plus one for a matrix: the same double arithmetic, missing values 0."""
    with np.errstate(invalid="ignore"):
        b = np.ceil((x - np.array(spec.lo)) / np.array(spec.width)) - 1
    return np.where(np.isnan(x), 0, np.clip(b, 0, spec.n_bins - 1) + 1).astype("<u2")


def pack_rows(fx_y: DataFrame, spec: BinSpec, n_features: int) -> DataFrame:
    """(n, y, b): chunks of rows as class and bin numbers (0: missing); rows without a class are left out."""
    kind = pa.schema([("n", pa.int32()), ("y", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, bs, n = [], [], 0

        def out() -> pa.RecordBatch:
            y, b = np.concatenate(ys), np.concatenate(bs)
            ys.clear(), bs.clear()
            return pa.RecordBatch.from_pylist([{"n": len(y), "y": y.tobytes(), "b": np.ascontiguousarray(b).tobytes()}], kind)

        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype("<i4")
            there = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            x = np.full((len(y), n_features), np.nan)
            x[there] = batch.column(1).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
            ys.append(y), bs.append(bin_numbers(x, spec))
            n += len(y)
            if n >= CHUNK_ROWS:
                yield out()
                n = 0
        if n:
            yield out()

    rows = fx_y.where("y IS NOT NULL").select("y", F.col("x").cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "n int, y binary, b binary")


def dense_counts(fx_y: DataFrame, spec: BinSpec, pairs: Sequence[tuple[int, int]] | None, n_features: int,
                 n_classes: int, n_rows: int) -> tuple[DataFrame, bool]:
    """((pair_id, bi, bj, ns array<long>), whole): per occupied cell the count of every class.

    ``whole`` tells that each cell is one row; where several tasks share a block (``n_rows``
    above ``GROUP_ROWS``) a cell has a row a task, to be summed."""
    side = spec.n_bins + 1
    if side > 1 << 16:
        raise ValueError("up to 65,535 bins a feature")
    n_pairs = n_features * (n_features - 1) // 2 if pairs is None else len(pairs)
    cells = side * side * n_classes
    groups = max(1, -(-n_rows // GROUP_ROWS))
    at_once = 2 * fx_y.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(n_pairs, max(-(-n_pairs * cells * 8 // BLOCK_BYTES), -(-at_once // groups))))
    width = max(1, -(-n_pairs // blocks))
    blocks = max(1, -(-n_pairs // width))
    dense = cells * 8 <= BLOCK_BYTES
    given = None if pairs is None else fx_y.sparkSession.sparkContext.broadcast(np.array(list(pairs), np.int64).reshape(-1, 2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, first, second = -1, None, None, None
        kept_y, kept_b, held = [], [], 0

        def add() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            y, b = np.concatenate(kept_y).astype(np.int64), np.concatenate(kept_b).astype(np.int64)
            kept_y.clear(), kept_b.clear()
            held = 0
            if dense:
                step = max(1, (1 << 21) // len(y))
                for a in range(0, len(first), step):
                    i, j = first[a : a + step], second[a : a + step]
                    code = ((b[:, i] * side + b[:, j]) * n_classes + y[:, None]) + np.arange(len(i)) * cells
                    total[a : a + step] += np.bincount(code.ravel(), minlength=len(i) * cells).reshape(len(i), cells)
            else:
                for a in range(len(first)):
                    code, n = np.unique((b[:, first[a]] * side + b[:, second[a]]) * n_classes + y, return_counts=True)
                    place, inverse = np.unique(code // n_classes, return_inverse=True)
                    for s in range(0, len(place), 1024):
                        own = (inverse >= s) & (inverse < s + 1024)
                        ns = np.zeros((min(1024, len(place) - s), n_classes), np.int64)
                        ns[inverse[own] - s, code[own] % n_classes] = n[own]
                        yield rows(np.full(len(ns), block * width + a), place[s : s + 1024], ns)

        def rows(pair: np.ndarray, place: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
            offsets = pa.array(np.arange(0, ns.size + 1, n_classes, dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array((place // side - 1).astype(np.int32)), pa.array((place % side - 1).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(ns).ravel()))], names=["pair_id", "bi", "bj", "ns"])

        def finish() -> Iterator[pa.RecordBatch]:
            yield from add()
            if block >= 0 and dense:
                by = total.reshape(len(first), side * side, n_classes)
                for a in range(0, len(first), max(1, (1 << 18) // (side * side))):
                    part = by[a : a + max(1, (1 << 18) // (side * side))]
                    pair, place = np.nonzero(part.any(axis=2))
                    if len(pair):
                        yield rows(block * width + a + pair, place, part[pair, place])

        for batch in batches:
            for k in range(batch.num_rows):
                now, n = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                if now != block:
                    yield from finish()
                    block = now
                    ids = np.arange(block * width, min((block + 1) * width, n_pairs))
                    first, second = unrank_pairs(ids, n_features) if given is None else given.value[ids].T
                    total = np.zeros((len(ids), cells), np.int64) if dense else None
                kept_y.append(np.frombuffer(batch.column(3)[k].as_buffer(), "<i4"))
                kept_b.append(np.frombuffer(batch.column(4)[k].as_buffer(), "<u2").reshape(n, n_features))
                held += n
                if held >= CHUNK_ROWS:
                    yield from add()
        yield from finish()

    chunks = pack_rows(fx_y, spec, n_features)
    grp = F.pmod(F.xxhash64("y", "b"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long")
    dealt = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), grp.alias("grp"), "n", "y", "b")
    # one partition for each block and group: a task's rows are its own block's only
    dealt = dealt.repartitionById(blocks * groups, (F.col("block") * groups + F.col("grp")).cast("int"))
    out = dealt.mapInArrow(count, "pair_id int, bi int, bj int, ns array<bigint>")
    return out, groups == 1 and dense
