"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs are quantised to levels of a logarithmic scale; a pair of
level q is put into a Bloom filter q times, once with each level's number.  A
reader probes level 1, 2, ... until one is missing and so learns the level, and
never reads a count that is too low by more than the scale's step.

The filter is made of parts by the upper bits of a pair's hash.  Tasks count
pairs in sorted blocks, blocks meet by part, and a part is built and sized for
the pairs it holds.  Parts are broadcast together as long as they stay below
``max_broadcast`` bytes; a larger model is broadcast in several rounds, each
scoring the pairs of its own parts, and the rounds' sums are added.  So nothing
is pruned and no broadcast grows with the corpus.

Word counts are exact (words are told apart by 64-bit hashes).  Documents are
dealt into blocks; each block asks for the counts of its own distinct words by a
join, so the vocabulary is never held in one place either.

The probability of a word after another is (pairs + mu * p(word)) / (count of
the first + mu), with the add-one unigram p(word) = (c + 1) / (N + V + 1) below
it.  The end of a text is a token, and stands before its first word as well.

Null and blank texts are the end token alone.  Null ids train and are never
held out.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.llm.common import mix64, pieces_of, stash, text_stats, words_of

#: Stands for the end of a text; no word is empty.
END = b""
BLOCK_BYTES, PART_BYTES, CHUNK_PAIRS = 16 << 20, 8 << 20, 1 << 21
BASE, PROBES, BITS_PER_ENTRY = 1.6, 4, 11
MAX_BROADCAST = 128 << 20


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def text_pieces(texts: list[bytes | None], limit: int = 1 << 21) -> Iterator[list[list[bytes]]]:
    """The words of the texts, of about ``limit`` bytes of them at a time."""
    for a, b in pieces_of(np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts)), limit):
        yield [words_of(t) for t in texts[a:b]]


def with_ends(words: np.ndarray, counts: np.ndarray, end) -> np.ndarray:
    """The texts' words in a row with ``end`` before the first text and after each."""
    return np.r_[words.dtype.type(end), np.insert(words, np.cumsum(counts), end)]


def packed(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as their differences, byte plane by byte plane (the upper ones compress away)."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def word_hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(first * np.uint64(0x9E3779B97F4A7C15) + second)


def part_of(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)


def levels(counts: np.ndarray, base: float = BASE) -> np.ndarray:
    """Quantised counts: 1 + floor(log_base count)."""
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def level_values(n: int, base: float = BASE) -> np.ndarray:
    """Expected count of each level from 0 on (mean of the counts a level can stand for)."""
    out = [0.0]
    for q in range(1, n + 1):
        lo, hi = math.ceil(base ** (q - 1) - 1e-9), math.ceil(base**q - 1e-9) - 1
        out.append((lo + max(lo, hi)) / 2)
    return np.array(out)


def slots(keys: np.ndarray, level, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bit places of (key, level) in a filter of ``size`` bits, one array a probe."""
    with np.errstate(over="ignore"):
        h = mix64(keys ^ (np.asarray(level, np.uint64) * np.uint64(0xD1342543DE82EF95)))
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        for i in range(PROBES):
            yield ((a + np.uint64(i) * b & np.uint64(0xFFFFFFFF)) * np.asarray(size, np.uint64)) >> np.uint64(32)


def build_part(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of one part: bits for every pair at every level up to its own."""
    q = levels(counts)
    n_bits = max(64, -(-int(q.sum()) * BITS_PER_ENTRY // 64) * 64)
    bits = np.zeros(n_bits, bool)
    for level in range(1, int(q.max()) + 1):
        for at in slots(keys[q >= level], level, n_bits):
            bits[at] = True
    return np.packbits(bits).tobytes()


@dataclass
class Filter:
    """The parts from ``low`` up to ``high`` of a filter, side by side: probe with ``read``."""

    shift: int
    low: int
    high: int
    start: np.ndarray
    size: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, shift: int, low: int, high: int, parts: dict[int, bytes]) -> Filter:
        size = np.array([8 * len(parts.get(p, b"")) for p in range(low, high)], np.int64)
        data = b"".join(parts.get(p, b"") for p in range(low, high))
        return cls(shift, low, high, np.cumsum(size) - size, size, np.frombuffer(data, np.uint8))

    def part(self, keys: np.ndarray) -> np.ndarray:
        return part_of(keys, self.shift)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        part = self.part(keys)
        return (part >= self.low) & (part < self.high)

    def read(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key (0: not seen), probing upwards until a level is missing.  Keys must be held."""
        part = self.part(keys) - self.low
        found, live, level = np.zeros(len(keys), np.int64), np.flatnonzero(self.size[part] > 0), 0
        while len(live):
            level += 1
            base, size, k = self.start[part[live]], self.size[part[live]], keys[live]
            on = np.arange(len(live))
            for at in slots(k, level, size):
                where = base[on] + at[on].astype(np.int64)
                on = on[(self.data[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1 == 1]
            live = live[on]
            found[live] = level
        return found


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def filter_parts(texts: DataFrame, shift: int) -> DataFrame:
    """(part, bits) from the texts' word pairs: counted in blocks, added by part, built by part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(keys: list[np.ndarray]) -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(keys), return_counts=True)
            part = part_of(k, shift)
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            spans = list(zip(at, np.r_[at[1:], len(k)], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int64()), pa.array([packed(k[a:b]) for a, b in spans], pa.binary()), pa.array([packed_counts(n[a:b]) for a, b in spans], pa.binary())], names=["part", "pairs", "counts"])

        kept, n = [], 0
        end = word_hashes([END])[0]
        for batch in batches:
            for words in text_pieces(raw_texts(batch.column(0))):
                counts = np.fromiter(map(len, words), np.int64, len(words))
                h = with_ends(np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts, end)
                kept.append(pair_keys(h[:-1], h[1:]))
                n += len(h) - 1
                if n >= CHUNK_PAIRS:
                    yield told(kept)
                    kept, n = [], 0
        if kept:
            yield told(kept)

    def build(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(b) for b in blocks.column("pairs").to_pylist()])
        counts = np.concatenate([unpacked_counts(b) for b in blocks.column("counts").to_pylist()])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([build_part(*summed(keys, counts))], pa.binary())})

    return texts.mapInArrow(count, "part long, pairs binary, counts binary").groupBy("part").applyInArrow(build, "part long, bits binary")


def block_words(blocks: DataFrame) -> DataFrame:
    """(block, word, n): hashes of each block's distinct words, n times in its training rows."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        rest: set[bytes] = {END}
        train = table.column("train").to_pylist()
        for t, learns in zip(raw_texts(table.column("text")), train, strict=True):
            (seen if learns else rest).update(words_of(t))
        seen[END] += sum(train)
        rest -= seen.keys()
        n = np.r_[np.fromiter(seen.values(), np.int64, len(seen)), np.zeros(len(rest), np.int64)]
        words = signed(word_hashes([*seen, *rest]))
        return pa.table({"block": pa.array(np.full(len(n), key[0].as_py()), pa.int64()), "word": pa.array(words, pa.int64()), "n": pa.array(n, pa.int64())})

    return blocks.groupBy("block").applyInArrow(run, "block long, word long, n long")


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", mu: float = 200.0, max_broadcast: int = MAX_BROADCAST, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``;
    ``train`` is a boolean expression, and the model learns from the rows where it holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), train.alias("train"))
    _, n_bytes = text_stats(rows)
    n_blocks = max(1, -(-n_bytes // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id", "text"), F.lit(n_blocks)).cast("long"))

    asked = stash(block_words(rows))
    vocabulary = asked.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    given = asked.join(vocabulary, "word", "left").select("block", "word", F.coalesce("c", F.lit(0)).alias("c"))

    bits = max(0, math.ceil(math.log2(max(1, n_bytes / part_bytes))))
    parts = stash(filter_parts(rows.where("train").select("text"), 64 - bits))
    rounds, room = [0], max_broadcast
    for r in parts.select("part", F.octet_length("bits").alias("b")).orderBy("part").collect():
        if r["b"] > room and r["part"] > rounds[-1]:
            rounds.append(r["part"])
            room = max_broadcast
        room -= r["b"]
    rounds.append(1 << bits)

    out = None
    for low, high in zip(rounds, rounds[1:], strict=False):
        got = parts.where((F.col("part") >= low) & (F.col("part") < high)).toArrow()
        own = dict(zip(got.column("part").to_pylist(), got.column("bits").to_pylist(), strict=True))
        told = spark.sparkContext.broadcast(Filter.of(64 - bits, low, high, own))
        part = scored_blocks(rows, given, told, total, distinct, mu)
        out = part if out is None else out.union(part)
    if len(rounds) > 2:
        same = ["block", "place"]
        whole = [F.max(c).alias(c) for c in ("id", "train", "n_tokens", "n_known", "base_score")]
        out = out.groupBy(*same).agg(*whole, F.sum("score").alias("score"))
    return out.select("id", "train", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def scored_blocks(rows: DataFrame, given: DataFrame, told, total: int, distinct: int, mu: float) -> DataFrame:
    """Token counts and base scores, and the score of the pairs that this round's filter holds."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, counts: pa.Table) -> pa.Table:
        lm: Filter = told.value
        worth = level_values(64)
        asked = counts.column("word").to_numpy()
        order = np.argsort(asked)
        asked, given = asked[order], counts.column("c").to_numpy()[order].astype(float)
        index: dict[bytes, int] = {END: 0}  # words of this block as they come, their hashes and counts
        h = word_hashes([END])
        c = given[np.searchsorted(asked, signed(h))]
        if docs.num_rows > 1:
            docs = docs.sort_by([("id", "ascending"), ("text", "ascending")])
        res = []
        for words in text_pieces(raw_texts(docs.column("text"))):
            flat = list(chain.from_iterable(words))
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            at = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
            new = np.flatnonzero(at < 0).tolist()
            if new:
                fresh = list(dict.fromkeys(flat[i] for i in new))
                index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
                at[new] = [index[flat[i]] for i in new]
                more = word_hashes(fresh)
                h, c = np.r_[h, more], np.r_[c, given[np.searchsorted(asked, signed(more))]]
            tokens = with_ends(at, sizes, 0)
            a, b = tokens[:-1], tokens[1:]
            starts = np.cumsum(sizes + 1) - (sizes + 1)
            # each different pair is looked up once
            pairs, back = np.unique(pair_keys(h[a], h[b]), return_inverse=True)
            mine = lm.holds(pairs)
            level = np.zeros(len(pairs), np.int64)
            level[mine] = lm.read(pairs[mine])
            p = (c + 1) / (total + distinct + 1)
            n = np.minimum(worth[level][back], c[a])
            term = np.where(mine[back], np.log10((n + mu * p[b]) / (c[a] + mu)), 0.0)
            res.append(np.c_[sizes + 1, np.add.reduceat(c[b] > 0, starts, dtype=float), np.add.reduceat(np.log10(p)[b], starts), np.add.reduceat(term, starts)])
        res = np.concatenate(res) if res else np.zeros((0, 4))
        n = docs.num_rows
        return pa.table({"block": pa.array([key[0].as_py()] * n, pa.int64()), "place": pa.array(np.arange(n), pa.int64()), "id": docs.column("id"), "train": docs.column("train"), "n_tokens": pa.array(res[:, 0].astype(np.int64)), "n_known": pa.array(res[:, 1].astype(np.int64)), "base_score": pa.array(res[:, 2]), "score": pa.array(res[:, 3])})

    kind = rows.schema["id"].dataType.simpleString()
    fields = f"block long, place long, id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double"
    return rows.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, fields)
