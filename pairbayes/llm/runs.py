"""Periodic runs of words, by Baier's grouping.

A run is a stretch of consecutive words with smallest period q, at least
``max(least_length, least_exponent * q)`` words long, that no neighbouring word
extends.  Every run holds a Lyndon root under one of the two orders of its words
(one the reverse of the other), and that root is the longest Lyndon word that
starts at its place.  Phase one of Baier's suffix sorter groups the suffixes by
just that word, so its group lengths are the Lyndon array: no suffix array is
made.  Each root is then extended to both sides as far as words one period apart
agree.

Before the grouping, stretches that cannot hold a run are cut away: in a run every
word occurs at least ``least_exponent`` times, and every three words in a row
occur several times within the stretch (``may_repeat``).  This is a bound, not a
sample; what stays is grouped whole, whatever its length.

Results on unusual input: null, empty and blank texts have no words and no runs,
and ``collapsed`` is empty.  Null ids, repeated rows and extra columns pass
through unchanged in ``record``, one row out for each row in; an empty table gives
an empty table.  Ties cannot occur: a run is its start, length and period.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.llm.common import slices

Run = tuple[int, int, int]


def lyndon_lengths(words: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place (a shorter prefix is the smaller word).

    Groups hold the suffixes whose longest Lyndon word, as far as it is known, is the
    same.  They are taken from the greatest down.  A group that is taken is final; the
    nearest open place to the left of each of its members takes the group's word to
    the end of its own, once for each member that points to it."""
    n = len(words)
    at = {w: g for g, w in enumerate(sorted(set(words)))}
    group = [at[w] for w in words]
    members: list[list[int]] = [[] for _ in at]
    for i, g in enumerate(group):
        members[g].append(i)
    size, length = [len(m) for m in members], [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    top = len(members) - 1
    above[top:] = [-1]
    out, left = [0] * n, list(range(-1, n - 1))
    g = top
    while g >= 0:
        own, long = [i for i in members[g] if group[i] == g], length[g]
        for i in own:
            out[i] = long  # 0 as long as a place is open
        pointed: dict[int, int] = {}
        for i in own:
            j = left[i]
            while j >= 0 and out[j]:
                k = left[j]
                if k >= 0 and out[k]:
                    left[j] = k = left[k]
                j = k
            left[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for (times, h), moved in sorted(moves.items()) if len(moves) > 1 else moves.items():
            if len(moved) == size[h]:
                length[h] -= times * long
                continue
            new = len(size)
            size[h] -= len(moved)
            size.append(len(moved))
            members.append(moved)
            length.append(length[h] - times * long)
            up = above[h]  # the new group stands just above the one it leaves
            below.append(h)
            above.append(up)
            above[h] = new
            if up >= 0:
                below[up] = new
            for j in moved:
                group[j] = new
        g = below[g]
    return out


def agreeing(x: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` > a on (longest common extension)."""
    n, k, step = len(x) - b, 0, 16
    while k < n:
        end = min(n, k + step)
        differ = x[a + k : a + end] != x[b + k : b + end]
        first = int(differ.argmax())
        if differ[first]:
            return k + first
        k, step = end, step * 4
    return n


def may_repeat(x: np.ndarray, exponent: int, least: int, rounds: int = 6) -> list[tuple[int, int]]:
    """Stretches (start, end) outside of which no run lies.

    In a run of period q each word occurs ``exponent`` times or more, and each three
    words in a row ``exponent - 1`` times (``least - 2`` for q = 1).  Places that fail
    are cut; within the stretches that are left the same must hold again.  Stopping
    after ``rounds`` leaves stretches longer, never shorter than they must be."""
    n = len(x)
    if n < least:
        return []
    need, m = min(exponent - 1, max(least, exponent) - 2), int(x.max()) + 1
    often = np.bincount(x, minlength=m)[x] >= exponent
    start = np.flatnonzero(often[:-2] & often[1:-1] & often[2:])
    two = x[start] * m + x[start + 1]
    if m > 1 << 20:
        two = np.unique(two, return_inverse=True)[1]
    three = np.unique(two * m + x[start + 2], return_inverse=True)[1] if len(start) else start
    for _ in range(rounds):
        if not len(start):
            return []
        stretch = np.cumsum(np.diff(start, prepend=start[0] - 1) != 1)
        key = stretch * (int(three.max()) + 1) + three
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        cut = np.flatnonzero(np.diff(ordered, prepend=ordered[0] - 1))
        count = np.empty(len(key), np.int64)
        count[order] = np.repeat(np.diff(cut, append=len(key)), np.diff(cut, append=len(key)))
        stay = (count >= need) & (np.bincount(stretch)[stretch] >= least - 2)
        if stay.all():
            break
        start, three = start[stay], three[stay]
    if not len(start):
        return []
    first = np.flatnonzero(np.diff(start, prepend=start[0] - 2) != 1)
    last = np.append(first[1:], len(start)) - 1
    return [(a, b + 3) for a, b in zip(start[first].tolist(), start[last].tolist(), strict=True)]


def runs_in(x: np.ndarray, exponent: int, least: int) -> set[Run]:
    """Runs (start, length, period) of a stretch of word numbers."""
    n, found = len(x), set()
    for order in (x, -x):
        p = np.array(lyndon_lengths(order.tolist()), np.int64)
        i = np.flatnonzero(np.arange(n) + 2 * p <= n)
        p_i = p[i]
        # a run of three periods or more holds its root twice in a row
        i = i[(p[i + p_i] == p_i) & (x[i] == x[i + p_i]) & (x[i + p_i - 1] == x[i + 2 * p_i - 1]) & (exponent * p_i <= n)]
        reached: dict[int, int] = {}
        for a, q in zip(i.tolist(), p[i].tolist(), strict=True):
            if a + q <= reached.get(q, 0):
                continue  # this root lies in a stretch that is already extended
            b = reached[q] = a + q + agreeing(x, a, a + q)
            a -= agreeing(x[::-1], n - a - q, n - a)
            if b - a >= max(least, exponent * q):
                found.add((a, b - a, q))
    return found


def runs_of(words: list, exponent: int = 4, least: int = 6) -> list[Run]:
    """All runs (start, length, period) of a sequence of hashable words, by start, then period."""
    if exponent < 3:
        raise ValueError("roots are looked for in pairs: the exponent must be 3 or more")
    if len(words) < max(least, exponent):
        return []
    number: dict = defaultdict()
    number.default_factory = number.__len__
    x = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    least = max(least, 3)
    found = {(a + s, length, q) for a, b in may_repeat(x, exponent, least) for s, length, q in runs_in(x[a:b], exponent, least)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[Run]) -> list:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """One row for each row: ``record`` (a struct of the columns of ``docs``), ``n_words``,
    ``runs`` (array of start, length, period) and ``collapsed``, the text without the
    repeats of each run.  Each text is worked on whole, in the task that reads it."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            record = part.column(0)
            counts, runs, texts = [], [], []
            for text in record.field(at).to_pylist():
                words = text.encode().split() if text else []
                found = runs_of(words, exponent, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(kept_words(words, found)).decode())
            yield pa.RecordBatch.from_arrays([record, pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=["record", "n_words", "runs", "collapsed"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    return rows.mapInArrow(run, f"record {rows.schema['record'].dataType.simpleString()}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
