"""Packing along a space-filling curve.

Each document is tokenised once; its token ids, hashed into a long vector, are
projected to a few dimensions, and the point's place on a Hilbert curve is the
sort key.  A range sort puts neighbours side by side, and every task packs its
stretch of the curve into sequences.  The tokenised table is written first, so
the range sort samples and reads a file rather than tokenising again.

Nulls: a null text counts as empty and gives the end id alone; null ids sort
first and stay.  Repeated rows are packed as often as they occur.  An empty
table gives no pieces.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.llm.common import give_back, mix64, pieces_of, slices, stash

DIMS, BITS = 4, 15
#: Token ids in one range partition; a partition is what one task sorts and packs.
IDS_PER_TASK = 1 << 21


#: Signs (no apostrophe) at a word's end after a letter (ASCII or Latin-1) or digit: pieces of
#: their own for the tokeniser.
TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[a-z0-9][!-~])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][!-~]))[!-&(-/:-@\[-`{-~]*(?=[\x09-\x0D\x20]|\Z)")


def bare_words(text: bytes | None) -> list[bytes]:
    """Words of a text as the tokeniser sees them: lower-cased, signs at their ends parted off.
    Texts that may spell a special token stay as they are."""
    if not text:
        return []
    return text.split() if b"<|" in text else TAIL.sub(rb" \g<0>", text.lower()).split()


#: Mark of ids that end a word, as the tokeniser's vocabulary writes it.
WORD_END = "</w>"
#: Words that are encoded together, first in large groups.
GROUPS = (8192, 64)


class WordCodes:
    """Token ids of words, each distinct word encoded once.

    The tokeniser drops white space, lower-cases, and never joins letters with
    signs, so a text's ids are its words' ids put together.  Words not seen
    before are encoded many at a time.  At ``limit`` words, and after a task, the
    table is cut to the ``kept`` words that were met most often since the last cut."""

    def __init__(self, path: str, limit: int = 300_000, kept: int = 80_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.limit, self.kept = Tokenizer.from_file(path), limit, kept
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.len, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def cut(self) -> None:
        """Keep the most frequent words; what is kept has to be met again to stay."""
        words, hits = list(self.index), self.hits[: len(self.index)]
        stay = np.argsort(-hits, kind="stable")[: self.kept]
        stay = np.sort(stay[hits[stay] > 1])
        start, lens, flat = self.start[stay], self.len[stay], self.flat
        self.clear()
        ids = flat[np.repeat(start - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]
        self.keep([words[i] for i in stay.tolist()], ids, lens)

    def keep(self, words: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.index)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.start):
            self.start, self.len, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.len, self.hits))
        self.flat[self.used : self.used + len(ids)] = ids
        self.hits[n : n + len(words)] = 0
        self.start[n : n + len(words)], self.len[n : n + len(words)] = self.used + np.cumsum(lens) - lens, lens
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        self.used += len(ids)

    def learn(self, words: list[bytes]) -> None:
        """Words of letters go together: each is one piece, whose last id ends a word in the
        vocabulary, so the ids part themselves.  A group whose count is off goes in small
        groups, and what is off there, like all other words, is encoded one by one."""
        text = [w.decode("utf-8", "replace") for w in words]
        plain = [t.isalpha() and (t.isascii() or t == t.lower()) for t in text]
        todo, alone = [i for i, p in enumerate(plain) if p], [i for i, p in enumerate(plain) if not p]
        for size in GROUPS:
            groups = [todo[a : a + size] for a in range(0, len(todo), size)]
            todo = []
            for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(map(text.__getitem__, g)) for g in groups], add_special_tokens=False), strict=True):
                ids = np.fromiter(e.ids, np.uint32)
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(group) and last[-1] == len(ids) - 1:
                    self.keep(list(map(words.__getitem__, group)), ids, np.diff(last, prepend=-1))
                else:
                    todo += group
        alone += todo
        ids = [e.ids for e in self.tok.encode_batch_fast([text[i] for i in alone], add_special_tokens=False)]
        self.keep([words[i] for i in alone], np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def encode(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and the count of each text."""
        split = [bare_words(t) for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.index) > self.limit:
            self.cut()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(at < 0).tolist()
        if fresh:
            self.learn(list(dict.fromkeys(words[i] for i in fresh)))
            at[fresh] = [self.index[words[i]] for i in fresh]
        self.hits[: len(self.index)] += np.bincount(at, minlength=len(self.index))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        lens = self.len[at]
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat((self.start[at] - (ends - lens)).astype(np.int32), lens) + np.arange(int(lens.sum()), dtype=np.int32)]
        upto = np.concatenate([[0], ends])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        n = np.diff(upto, prepend=0) + 1
        return np.insert(ids, upto, np.uint32(end_id)), n


_CODES: dict[str, WordCodes] = {}


def word_codes(path: str) -> WordCodes:
    """The worker's own tokeniser, kept from task to task; its table is cut after each."""
    if path not in _CODES:
        _CODES[path] = WordCodes(path)
    return _CODES[path]


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits a dimension.

    Gray-code transform of the coordinates bit by bit, from the highest, then
    the bits are interleaved; all points go through it at once."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for shift in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << shift), np.int64((1 << shift) - 1)
        for i in range(d):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] & (1 << shift), (1 << shift) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> shift) & 1)
    return key


def projection(n: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    """Row t: the gaussian direction of hashed coordinate t (rebuilt from the seed anywhere)."""
    with np.errstate(over="ignore"):
        u = [(mix64(np.arange(n * dims, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + k)) >> np.uint64(11)).astype(float) / 2**53 for k in (0, 1)]
    return (np.sqrt(-2 * np.log(1 - u[0])) * np.cos(2 * np.pi * u[1])).reshape(n, dims).astype(np.float32)


def curve_keys(ids: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its ids (one after another, ``n`` each)."""
    starts = np.cumsum(n) - n
    slots = ids.astype(np.int64) % len(table)
    seen, norm = np.zeros(len(table), np.int64), np.empty(len(n))
    for i, (a, k) in enumerate(zip(starts.tolist(), n.tolist(), strict=True)):
        own = slots[a : a + k]
        np.add.at(seen, own, 1)
        norm[i] = np.sqrt(seen[own].sum())  # each id adds its slot's count: the sum of squares
        seen[own] = 0
    z = np.add.reduceat(table[slots], starts, axis=0) / norm[:, None]
    cells = 1 / (1 + np.exp(-1.702 * z.astype(float)))
    return hilbert_key(np.minimum((cells * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", hashed: int = 1 << 16) -> DataFrame:
    """(id, ids as little-endian 32-bit binary, n_ids, curve key) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(tokenizer_path)
        table = projection(hashed)
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in pieces_of(np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))):
                ids, n = codes.encode(texts[a:b], end_id)
                raw, upto = ids.astype("<u4"), np.cumsum(n)
                out = [raw[e - k : e].tobytes() for e, k in zip(upto.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.array(curve_keys(ids, n, table), pa.int64())], names=["id", "ids", "n_ids", "curve_key"])
        codes.cut()  # a worker lives on for other stages: it keeps a small table only
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, n_ids long, curve_key long")


def cut_stretch(batches: Iterator[pa.RecordBatch], part: int, length: int) -> Iterator[pa.RecordBatch]:
    """Cut one stretch of the curve into sequences of ``length`` ids.

    Only the last, short sequence of a stretch is left over; it is cut into
    sequences whose lengths are powers of two, which need no padding either."""
    serial, fill = part << 40, 0
    open_pieces: list[tuple] = []
    rows: list[tuple] = []
    schema = None

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        schema = schema or pa.schema([("id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        for key, raw, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            view, at = memoryview(raw.as_buffer()), 0
            while at < n:
                take = min(n - at, length - fill)
                open_pieces.append((key, at, take, bytes(view[4 * at : 4 * (at + take)]), n, serial, fill))
                at, fill = at + take, fill + take
                if fill == length:
                    rows += open_pieces
                    open_pieces, serial, fill = [], serial + 1, 0
        if rows:
            yield flush()
    room = 0
    for key, start, n, raw, total, _, _ in open_pieces:
        at = 0
        while at < n:
            if not room:
                size = room = 1 << (fill.bit_length() - 1)
            take = min(n - at, room)
            rows.append((key, start + at, take, raw[4 * at : 4 * (at + take)], total, serial, size - room))
            at, room, fill = at + take, room - take, fill - take
            serial += not room
    if rows:
        yield flush()


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids_per_task: int = IDS_PER_TASK) -> DataFrame:
    """Pieces of all documents: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ``sequence_id`` holds the range partition in its upper bits, so ids are
    unique and follow the curve without a count over the whole table."""
    table = stash(tokenised(docs, tokenizer_path, end_id, id_col, text_col))
    total = table.agg(F.sum("n_ids")).first()[0] or 0
    parts = max(1, -(-total // ids_per_task))
    order = ["curve_key", "id", F.crc32("ids")]
    ranged = table.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "ids", "n_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut_stretch(batches, TaskContext.get().partitionId(), length)
        give_back()

    kind = table.schema["id"].dataType.simpleString()
    return ranged.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
