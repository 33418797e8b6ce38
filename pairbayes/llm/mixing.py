"""Mixing sources to target weights by a hypergeometric splitting tree.

The words of a source lie on one line, document after document in a seeded
order, cut into blocks.  A source takes whole rounds over all its blocks and
then the first blocks of a seeded permutation, the last one cut so that its
quota is met to the word.  The blocks of all sources are dealt to the output
shards by a binary tree: at every node the blocks going left are drawn from the
sources' remaining quotas by a multivariate hypergeometric law, so each shard
has its exact number of blocks and, in mean, the mix of the whole.  Shards take
disjoint stretches of each source's drawn order, and a shard is put in a seeded
order of its own.  What is taken is what the tree deals: a block belongs to the mix
if its turn lies within its source's quotas.

Rows of a source are spread over buckets by a hash, and places on the line are
sums within a bucket on top of the sums of the buckets before it, so a source
with a third of all rows is no single task.  What the driver holds is one entry
a source; more than ``MAX_SOURCES`` raise an error.

A null source is a source (last in order); null and blank texts have no words
and take none.  Repeated rows are rows of their own.  An empty table gives none.
The columns of the input come back in the struct ``record``, so no name can clash.
Blocks are ``block`` words long; above ``MOST_BLOCKS`` blocks in the whole mix they
grow in proportion (at 256 words beyond 100 billion words), because the draws count
blocks exactly only below a billion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairbayes.llm.common import mix64, slices, stash, word_count

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
MAX_SOURCES, ROWS_PER_BUCKET, BLOCK, MOST_BLOCKS = 100_000, 2000, 256, 400_000_000
PIECES = "array<struct<copy:int,start:long,words:long,shard:int,place:long>>"


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Share of ``share`` times all words by weight; what exceeds ``cap`` times a
    source's words is shared again among the others until none exceeds."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))])
    most, got = cap * np.array(sizes, float), np.zeros(len(sizes))
    left, free = share * float(sum(sizes)), np.ones(len(sizes), bool)
    while free.any() and left > 0:
        want = left * w / w[free].sum()
        over = free & (want > most)
        if not over.any():
            got[free] = want[free]
            break
        got[over], free = most[over], free & ~over
        left = share * float(sum(sizes)) - float(got[~free].sum())
    return got.tolist()


class Order:
    """A seeded permutation of 0..n-1 that is computed, not stored: a Feistel
    network over the next even number of bits, walked until it falls below n."""

    def __init__(self, n: int, seed: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**63))

    def once(self, x: np.ndarray) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> half, x & mask
        for k in self.keys:
            a, b = b, a ^ (mix64(b ^ k) & mask)
        return (a << half) | b

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self.once(x.astype(np.uint64))
        while (far := out >= self.n).any():
            out[far] = self.once(out[far])
        return out.astype(np.int64)


def drawn_blocks(n_words: int, take: int, block: int, seed: int) -> dict:
    """How a source meets ``take``: whole rounds, then ``first`` blocks of a permutation,
    the last of them cut to ``last`` words."""
    n = -(-n_words // block) if n_words else 0
    rounds, rest = divmod(take, n_words) if n_words else (0, 0)
    order, first, last = Order(n, seed) if n else None, 0, 0
    if rest:
        short = n_words - (n - 1) * block
        at = int(order(np.array([n - 1]))[0])  # where the short block falls
        first = -(-rest // block)
        if at < first:
            first = max(at + 1, -(-(rest + block - short) // block))
        before = (first - 1) * block - (block - short if at < first - 1 else 0)
        last = rest - before
    return {"n": n, "rounds": rounds, "first": first, "last": last, "seed": seed}


def hypergeometric(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """Of ``take`` draws without replacement, how many fall on each source: one
    conditional draw a source."""
    out, left = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        left -= c
        out[i] = rng.hypergeometric(c, left, take) if c and take else 0
        take -= int(out[i])
    return out


def shard_quotas(counts: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) in each shard (row), by the splitting tree."""
    quotas = np.zeros((n_shards, len(counts)), np.int64)
    todo = [(0, n_shards, counts.astype(np.int64))]
    while todo:
        a, b, here = todo.pop()
        if b - a == 1:
            quotas[a] = here
            continue
        mid, total = (a + b) // 2, int(here.sum())
        left = hypergeometric(np.random.default_rng([seed, a, b]), here, total * (mid - a) // (b - a))
        todo += [(a, mid, left), (mid, b, here - left)]
    return quotas


def mix(docs: DataFrame, n_shards: int = 16, seed: int = 5, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", block: int = BLOCK, n_buckets: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``record`` (its columns, or those in ``carry``), ``size``,
    ``source_size``, ``target`` and ``pieces``: the blocks of the row that the mix takes (copy, first
    word, words, shard, place in the shard).  The records are shuffled once."""
    spark = docs.sparkSession
    own = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    row_id, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    if n_buckets is None:
        n_buckets = max(1, -(-docs.count() // ROWS_PER_BUCKET))
    rows = docs.select(F.struct(*own).alias("record"), row_id.alias("id"), source.alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), row_id, text).alias("h"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(n_buckets)).cast("int"))

    sums = stash(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")))  # sources x buckets rows
    totals = sums.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    totals.sort(key=lambda r: (r[0] is None, str(r[0] or "").encode()))
    names, sizes = [r[0] for r in totals], [int(r[1]) for r in totals]
    goal = targets(sizes)
    width = max(block, -(-int(SHARE * sum(sizes)) // MOST_BLOCKS))
    plan = [drawn_blocks(s, min(round(t), int(CAP * s)), width, seed + 97 * i) for i, (s, t) in enumerate(zip(sizes, goal, strict=True))]
    quotas = shard_quotas(np.array([p["rounds"] * p["n"] + p["first"] for p in plan], np.int64), n_shards, seed)
    ends = np.cumsum(quotas, axis=0)

    # plain numbers as keys: the window and the join deal the records out once, by the same columns
    told = F.broadcast(spark.createDataFrame([(i, n, s, t) for i, (n, s, t) in enumerate(zip(names, sizes, goal, strict=True))], f"k int, name {rows.schema['source'].dataType.simpleString()}, source_size long, target double"))
    numbered = rows.join(told, rows["source"].eqNullSafe(told["name"])).drop("source", "name")
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.join(told, sums["source"].eqNullSafe(told["name"])).select("k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("k", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["k", "bucket"])
    placed = placed.select("record", "size", "source_size", "target", "k", (F.col("base") + F.col("inside")).alias("lo"))
    told_all = spark.sparkContext.broadcast((plan, ends, width, n_shards, seed))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, ends, width, n_shards, seed = told_all.value
        orders = [Order(p["n"], p["seed"]) if p["n"] else None for p in plan]
        for batch in slices(batches, 4000):
            k, lo, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (4, 5, 1))
            found = [_taken(plan[s], orders[s], ends[:, s], s, lo[k == s], size[k == s], width, seed) for s in np.unique(k)]
            rows_at = [np.flatnonzero(k == s) for s in np.unique(k)]
            doc = np.concatenate([r[f[0]] for r, f in zip(rows_at, found, strict=True)])
            cols = [np.concatenate([f[i] for f in found]) for i in range(1, 6)]
            by = np.lexsort((cols[1], cols[0], doc))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(k)))])
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            parts = pa.StructArray.from_arrays([pa.array(c[by], t) for c, t in zip(cols, kinds, strict=True)], ["copy", "start", "words", "shard", "place"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)], names=["record", "size", "source_size", "target", "pieces"])

    kinds = placed.select("record", "size", "source_size", "target").schema
    return placed.mapInArrow(take, StructType([*kinds.fields, *StructType.fromDDL(f"pieces {PIECES}").fields]))


def _taken(plan: dict, order, ends: np.ndarray, source: int, lo: np.ndarray, size: np.ndarray, width: int, seed: int) -> tuple:
    """Pieces of the rows at [lo, lo + size) of one source: row, copy, start, words, shard, place."""
    some = np.flatnonzero(size > 0)
    lo, hi = lo[some], lo[some] + size[some]
    b0, n = lo // width, (hi - 1) // width - lo // width + 1 if len(some) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(some)), n)
    block = np.repeat(b0 - (np.cumsum(n) - n), n) + np.arange(len(row))
    rank = order(block) if len(row) else block
    out = []
    for copy in range(plan["rounds"] + 1):
        last = copy == plan["rounds"]
        on = copy * plan["n"] + rank < (ends[-1] if len(ends) else 0)  # its turn is dealt to a shard
        r, b = row[on], block[on]
        stop = (b + 1) * width
        if last:
            stop = np.where(rank[on] == plan["first"] - 1, b * width + plan["last"], stop)
        start, stop = np.maximum(lo[r], b * width), np.minimum(hi[r], stop)
        some_words = stop > start
        r, b, start, stop = r[some_words], b[some_words], start[some_words], stop[some_words]
        turn = copy * plan["n"] + rank[on][some_words]
        shard = np.searchsorted(ends, turn, side="right")
        # a shard's own order: a seeded hash of (shard, source, turn), words of a block in sequence
        with np.errstate(over="ignore"):
            place = mix64(turn.astype(np.uint64) * np.uint64(1000003) + np.uint64(seed + 7919 * source)) >> np.uint64(1)
        out.append((some[r], np.full(len(r), copy), start - lo[r], stop - start, shard, place.astype(np.int64)))
    return tuple(np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(6))


def mixed_rows(mixed: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """One row for every run of words that one shard takes from a copy of a row: ``shard``, ``place``
    and the record, with those words as its text (white space inside kept)."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    kind = mixed.schema["record"].dataType
    names = kind.names
    text_at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            record = batch.column(0)
            at, texts, shards, places, which = [], [], [], [], 0
            for text, pieces in zip(record.field(text_at).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for p in pieces or []:
                    if runs and runs[-1][0] == p["copy"] and runs[-1][2] == p["start"] and runs[-1][3] == p["shard"]:
                        runs[-1][2] += p["words"]
                    else:
                        runs.append([p["copy"], p["start"], p["start"] + p["words"], p["shard"], p["place"]])
                spans = [m.span() for m in word.finditer(text)] if runs else []
                for _, a, b, shard, place in runs:
                    whole = a == 0 and b == len(spans)
                    texts.append(text if whole else text[spans[a][0] : spans[b - 1][1]])
                    at.append(which)
                    shards.append(shard)
                    places.append(place)
                which += 1
            took = pa.array(at, pa.int64())
            cols = [record.field(i).take(took) for i in range(len(names))]
            cols[text_at] = pa.array(texts, pa.string())
            if chars_col:
                cols[names.index(chars_col)] = pa.array([len(t) for t in texts], record.field(names.index(chars_col)).type)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(places, pa.int64()), pa.StructArray.from_arrays(cols, names)], names=["shard", "place", "record"])

    made = StructType([*StructType.fromDDL("shard int, place long").fields, mixed.schema["record"]])
    return mixed.select("record", "pieces").mapInArrow(cut, made)


def in_shard_order(rows: DataFrame) -> DataFrame:
    """``mixed_rows`` sorted by (shard, place) over the whole table: a range sort, so a shard may
    take several tasks and files, one after another."""
    return rows.orderBy("shard", "place", F.xxhash64("record"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Writes ``mixed_rows`` as one folder a shard (``shard=N``), in the shard's order."""
    in_shard_order(rows).select("shard", "place", "record.*").write.partitionBy("shard").parquet(path)
