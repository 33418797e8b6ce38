"""Near-duplicate detection with HyperMinHash registers.

A document's set is that of its distinct word shingles.  One 64-bit hash of a
shingle picks a bucket by its upper bits and offers the rest as a value; the
bucket keeps its smallest value as a leading-zero count and ten mantissa bits
(16 bits).  Empty buckets borrow from others in a seeded order (the same for
all documents).  Bands of five compressed registers name candidates; the share
of equal registers, corrected for chance collisions of compressed values, drops
those that are clearly apart; what is left is confirmed on the full sets.

Equal sets are one node from the start.  No step emits pairs: a task that
compares documents returns one star a component it finds, at most one row a
document.  A band bucket or a cluster above ``BLOCK`` members is split into
blocks, and each pair of blocks is a task's cell of its own, so every pair is
still compared.  At similarity 0.85 a link escapes the bands with probability
(1 - 0.85^5)^25 = 4e-7; the register estimate is cut at 0.65, six standard
deviations below 0.85.

Null, empty and blank texts have no shingles and link with nothing.  Rows with
equal ids are one id with several texts: each row gets its own text's group.  A
group's id is its smallest id that is not null; a group without any has none.
Kept is the first of a group by (id, nulls last, then text hash), with its exact
repetitions, and every row without shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbayes.llm.common import give_back, mix64, slices, stash, words_of
from pairbayes.llm.components import connected_components, stars

REGISTERS, MANTISSA, ROWS, BANDS = 128, 10, 5, 25
VALUE_BITS = 64 - 7
BLOCK, ESTIMATE_SLACK = 512, 0.2


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    with np.errstate(over="ignore"):
        x = np.zeros(len(h) - size + 1, np.uint64) + np.uint64(size)
        for k in range(size):
            x = (x ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
    return np.unique(mix64(x))


@cache
def borrow_order(tries: int = 4096) -> np.ndarray:
    """Row t: the bucket that each bucket turns to at its t-th try."""
    x = mix64(np.arange(tries * REGISTERS, dtype=np.uint64) + np.uint64(0x5EED))
    return (x % np.uint64(REGISTERS)).astype(np.int64).reshape(tries, REGISTERS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers (documents x ``REGISTERS``, 16 bits) of non-empty sorted sets."""
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(VALUE_BITS)
    values = np.zeros((len(sets), REGISTERS), np.uint64)
    full = np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        first = np.minimum(np.searchsorted(s, edges), len(s) - 1)
        values[i] = s[first]
        full[i] = (values[i] >> np.uint64(VALUE_BITS)) == np.arange(REGISTERS)
    values &= np.uint64((1 << VALUE_BITS) - 1)
    size = np.frexp(values.astype(np.float64))[1].astype(np.int64)  # bits in use
    zeros = np.maximum(VALUE_BITS - size, 0)
    mantissa = ((values << zeros.astype(np.uint64)) >> np.uint64(VALUE_BITS - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    regs = (zeros << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)
    filled, order = full.copy(), borrow_order()
    for row in order:
        need = np.flatnonzero(~filled.all(axis=1))
        if not len(need):
            break
        take = ~filled[need] & full[need][:, row]
        regs[need] = np.where(take, regs[need][:, row], regs[need])
        filled[need] |= take
    return regs


@cache
def chance(load: int) -> float:
    """Probability that two unrelated registers agree, each the smallest of 2^load values."""
    t = 2.0**load
    e = np.arange(VALUE_BITS)[:, None]
    low = 2.0 ** (-e - 1.0) * (1 + np.arange(1 << MANTISSA)[None, :] / 2.0**MANTISSA)
    cell = np.exp(t * np.log1p(-low)) - np.exp(t * np.log1p(-np.minimum(low + 2.0 ** (-e - 1.0 - MANTISSA), 1 - 1e-16)))
    return float((cell**2).sum())


def estimate(regs: np.ndarray, one: np.ndarray, n: np.ndarray, n_one: int) -> np.ndarray:
    """Jaccard estimates of ``one`` with each row: equal registers less chance collisions."""
    same = (regs == one).mean(axis=1)
    load = np.maximum(0, np.round(np.log2(np.maximum(np.sqrt(n * float(n_one)) / REGISTERS, 1)))).astype(int)
    c = np.array([chance(int(k)) for k in range(int(load.max()) + 1)])[load]
    return (same - c) / (1 - c)


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_hash, n_shingles, node, registers) a row; node and registers null without shingles."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in batch.column(1).cast(pa.binary())]
            some = [s for s in sets if len(s)]
            regs = iter(registers(some)) if some else iter(())
            node = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets], pa.int64())
            raw = pa.array([next(regs).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(map(len, sets)), pa.int64()), node, raw], names=["id", "text_hash", "n_shingles", "node", "registers"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "text_hash").mapInArrow(run, f"id {kind}, text_hash long, n_shingles long, node long, registers binary")


def celled(df: DataFrame, group: Column, size: Column, node: Column) -> DataFrame:
    """Copies of a group's rows for each pair of blocks that their block is in, as ``cell``
    and ``side`` (0 or 1, the block's place in the pair)."""
    blocks = F.ceil(size / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(3), node), blocks).cast("int")
    df = df.withColumns({"_g": group, "_n": blocks, "_m": mine})
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cell = F.xxhash64("_g", F.least("_m", "_o"), F.greatest("_m", "_o"))
    # the two blocks of a cell are compared, a block's own pairs only in the cell of that block alone
    return df.withColumns({"cell": cell, "side": (F.col("_m") > F.col("_o")).cast("int")}).drop("_g", "_n", "_m", "_o")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The cells of a task's sorted rows, one table each (first column: the cell)."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        at = np.flatnonzero(np.diff(table.column(0).to_numpy())) + 1
        for a, b in zip([0, *at[:-1]], at, strict=False):
            yield table.slice(a, b - a)
        kept = table.slice(at[-1]) if len(at) else table
    if kept is not None and kept.num_rows:
        yield kept


def dealt_by_cell(df: DataFrame) -> DataFrame:
    return df.repartition("cell").sortWithinPartitions("cell")


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def in_batches(cells: Iterator[list[tuple[int, int]]], limit: int = 20_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for edges in cells:
        out += edges
        if len(out) >= limit:
            yield edge_batch(out)
            out = []
    yield edge_batch(out)
    give_back()


def likely_edges(reps: DataFrame, least: float) -> DataFrame:
    """Stars over nodes that share a band and whose registers look at least ``least`` alike."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("registers", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)])
    banded = reps.select("node", F.explode(keys).alias("band"))
    sets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.sum(F.pmod(F.xxhash64("node"), F.lit(1 << 40))).alias("mark"), F.min("node").alias("low")).where("size > 1")
    # buckets of the same members are compared once
    once = sets.groupBy("size", "mark", "low").agg(F.min("band").alias("band"))
    members = banded.join(once.select("band", "size"), "band")
    rows = celled(members, F.col("band"), F.col("size"), F.col("node")).select("cell", "side", "node")
    rows = rows.join(reps.select("node", "n_shingles", "registers"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(cell: pa.Table) -> list[tuple[int, int]]:
            side, node, n = (cell.column(c).to_numpy() for c in ("side", "node", "n_shingles"))
            regs = np.frombuffer(b"".join(cell.column("registers").to_pylist()), "<u2").reshape(len(node), REGISTERS)
            linked = np.zeros((len(node), len(node)), bool)
            two = side.any()
            for i in range(len(node)):
                other = np.flatnonzero(side > side[i]) if two else np.arange(i + 1, len(node))
                if len(other):
                    linked[i, other] = estimate(regs[other], regs[i], n[other], int(n[i])) >= least
            return [(int(node[i]), int(node[j])) for i, j in stars(linked | linked.T)]

        yield from in_batches(map(compare, whole_cells(batches)))

    return dealt_by_cell(rows.select("cell", "side", "node", "n_shingles", "registers")).mapInArrow(run, "a long, b long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections.  Shingles with the same holders count as one column."""
    holder = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    marks = mix64(np.arange(1, len(sets) + 1, dtype=np.uint64))
    order = np.argsort(column, kind="stable")
    starts = np.flatnonzero(np.diff(column[order], prepend=-1))
    with np.errstate(over="ignore"):
        mark = np.add.reduceat(marks[holder[order]], starts)
    times = np.diff(starts, append=len(order))
    _, first, weight = np.unique(mark, return_index=True, return_counts=True)
    shared = times[first] > 1
    first, weight = first[shared], weight[shared]
    out = np.diag([float(len(s)) for s in sets])
    off = np.zeros_like(out)
    for a in range(0, len(first), 2048):
        x = np.zeros((len(sets), len(first[a : a + 2048])))
        lens = times[first[a : a + 2048]]
        cols = np.repeat(np.arange(len(lens)), lens)
        at = np.repeat(starts[first[a : a + 2048]] - (np.cumsum(lens) - lens), lens) + np.arange(len(cols))
        x[holder[order[at]], cols] = 1
        off += (x * weight[a : a + 2048]) @ x.T
    np.fill_diagonal(off, 0)
    return np.rint(out + off).astype(np.int64)


def confirmed_edges(docs: DataFrame, reps: DataFrame, clusters: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Stars over nodes whose full sets meet ``percent``: 100 * intersection >= percent * union."""
    sized = clusters.join(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    rows = sized.join(reps.select("node", "rep.*"), "node")
    rows = celled(rows, F.col("root"), F.col("size"), F.col("node")).select("cell", "side", "node", "id", "text_hash")
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.join(rows, texts["_id"].eqNullSafe(rows["id"]) & (texts["_hash"] == rows["text_hash"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(cell: pa.Table) -> list[tuple[int, int]]:
            node, first = np.unique(cell.column("node").to_numpy(), return_index=True)  # repeated rows
            side, text = cell.column("side").to_numpy()[first], cell.column("text")
            sets = [shingle_set(text[int(i)].as_buffer().to_pybytes(), shingle) for i in first]
            common = common_counts(sets)
            size = np.diag(common)
            linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
            if side.any():
                linked &= side[:, None] != side[None, :]
            np.fill_diagonal(linked, False)
            return [(int(node[i]), int(node[j])) for i, j in stars(linked)]

        yield from in_batches(map(compare, whole_cells(batches)))

    return dealt_by_cell(rows.select("cell", "side", "node", "text")).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept) of every row of ``docs``."""
    seen = stash(sketches(docs, id_col, text_col, shingle))
    reps = stash(seen.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("rep"), F.min("id").alias("low"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers")))
    clusters = stash(connected_components(likely_edges(reps, percent / 100 - ESTIMATE_SLACK)))
    links = connected_components(confirmed_edges(docs, reps, clusters, id_col, text_col, shingle, percent))
    lows = reps.select("node", "low", "rep").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = lows.groupBy("root").agg(F.min("low").alias("component_id"), F.min("rep").alias("first"))
    named = lows.join(groups, "root").select("node", "component_id", "first")
    out = seen.drop("registers").join(named, "node", "left")
    group = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    kept = F.col("node").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash")))
    return out.select("id", "text_hash", "n_shingles", group.alias("component_id"), kept.alias("kept"))
