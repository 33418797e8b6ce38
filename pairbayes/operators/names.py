"""Fuzzy and hybrid name matching (J5, J6) that scores few of all pairs.

Similarity of two lower-case stems is 2 * M / (|a| + |b|), where M counts the characters
in the longest common block and, left and right of it, in theirs, and so on; a stem that
contains the other has at least 0.8.  M cannot exceed the characters that both have,
counted with repetition.  With *numbered* characters (the first a, the second a, ...) as
tokens that is the size of an intersection of sets, so an exact prefix filter holds:

* lengths n and m can pass a threshold t only for t/(2-t) <= n/m <= (2-t)/t;
* both must then share ceil(t * (n+m) / 2) tokens, and if each is sorted rarest first,
  they share one among the first n - ceil(..) + 1 and m - ceil(..) + 1.

So ``candidates`` is an equi-join on tokens, with lengths and places as conditions; a pair
is met at its rarest shared token only and checked by the whole intersection.

The match needs one file a target.  Names of few letters share nearly all tokens, so there
blocks of names of like length meet, in one task each: pairs that share too few characters
are left, then those whose longest common subsequence, which holds all common blocks, is too
short, and the rest is scored from the highest bound down.  A task returns its best: pairs
are never rows.

A stem that is contained in a much longer one passes outside that bound.  It has a key
of its own: the shorter stem's rarest stretch of four characters (the whole stem, if it
is shorter), joined with all stretches of the longer ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbayes.functions.columns import coord_from_name
from pairbayes.operators.match import nearest_point
from pairbayes.session import cut_lineage

# Fixed values of the match: default threshold, similarity of contained names, distance
# below which coordinates decide, file endings that count as images, suffixes that a
# target name loses before it is compared (a file name loses one).
THRESHOLD = 0.6
CONTAINED = 0.8
NEAR = 1.0
ENDINGS = r"(?i)\.(jpeg|jpg|png)$"
TARGET_STEMS = 3
# Fixed values of the block search: in second names of 200 characters or more, characters
# that make up over 1 % of it, plus one, start no block.
LONG_NAME = 200
# Names of a block: so many targets meet so many files at once in a task.
TARGET_BLOCK = 128
FILE_BLOCK = 4096

GRAM = 4


def stem(name: Column, times: int = 1) -> Column:
    """Last part of a path without its last suffix (``times`` suffixes)."""
    out = F.regexp_extract(name, r"([^/]*)/*$", 1)
    for _ in range(times):
        out = F.regexp_replace(out, r"^(.+)\.[^.]+$", "$1")
    return out


def least_shared(total: Column, threshold: float) -> Column:
    """Characters that names of ``total`` length together must share."""
    return F.ceil(total * F.lit(threshold / 2) - F.lit(1e-9))


def numbered(stems: DataFrame) -> DataFrame:
    """(stem, token): every character with its number among its equals, 'a1', 'a2', 'b1'."""
    chars = stems.select("stem", F.explode(F.split("stem", "")).alias("c")).where("c <> ''")
    counted = chars.groupBy("stem", "c").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.select("stem", F.explode(F.sequence(F.lit(1), "n")).alias("k"), "c").select("stem", F.concat("c", F.col("k").cast("string")).alias("token"))


def token_sets(stems: DataFrame, tokens: DataFrame, seldom: DataFrame) -> DataFrame:
    """(stem, n, tokens): the tokens of every stem, rarest first."""
    ranked = tokens.join(seldom, "token").groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t"))
    return stems.join(ranked, "stem").select("stem", F.length("stem").alias("n"), F.transform("t", lambda x: x["token"]).alias("tokens"))


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """One row for each token that a partner of any length may meet first."""
    n = F.col("n")
    shortest = F.ceil(n * F.lit(threshold / (2 - threshold)) - F.lit(1e-9))
    first = F.greatest(F.lit(1), n - least_shared(n + shortest, threshold) + 1).cast("int")
    return sets.select("stem", "n", "tokens", F.posexplode(F.slice("tokens", F.lit(1), first)).alias("place", "token"))


def candidates(targets: DataFrame, files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, shared): the pairs of stems (column ``stem``, distinct on each side) whose shared
    characters allow a similarity of ``threshold``.  Every pair that reaches it by blocks is among them."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and up to 1")
    a_tokens, b_tokens = numbered(targets), numbered(files)
    seldom = a_tokens.select("token").unionAll(b_tokens.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    a = prefixes(token_sets(targets, a_tokens, seldom), threshold).toDF("a", "a_n", "a_tokens", "a_place", "token")
    b = prefixes(token_sets(files, b_tokens, seldom), threshold).toDF("b", "b_n", "b_tokens", "b_place", "token")
    both = F.col("a_n") + F.col("b_n")
    need = least_shared(both, threshold)
    rest = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    pairs = a.join(b, "token").where((need <= F.least("a_n", "b_n")) & (F.col("a_place") <= F.col("a_n") - need) & (F.col("b_place") <= F.col("b_n") - need) & (rest >= need))
    # a pair shares several prefix tokens; the rarest of all that it shares stands first in both
    shared = F.array_intersect("a_tokens", "b_tokens")
    return pairs.select("a", "b", "token", shared.alias("both"), need.alias("need")).where((F.element_at("both", 1) == F.col("token")) & (F.size("both") >= F.col("need"))).select("a", "b", F.size("both").alias("shared"))


def stretches(stems: DataFrame) -> DataFrame:
    """(stem, gram): all stretches of one to GRAM characters of every stem, once each."""
    n = F.length("stem")
    each = lambda q: F.when(n >= q, F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring("stem", i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return stems.select("stem", F.explode(F.array_distinct(F.concat(*[each(q) for q in range(1, GRAM + 1)]))).alias("gram"))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long): stems of ``short`` that lie in a longer or equal stem of ``long``; empty ones lie in none."""
    long_grams = stretches(long)
    seldom = long_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    n = F.length("stem")
    width = F.least(n, F.lit(GRAM))
    own = short.where(n > 0).select("stem", F.explode(F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.substring("stem", i, width))).alias("gram"))
    # a gram that no longer stem has means no match at all
    found = own.join(seldom, "gram", "left").groupBy("stem").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("g")).where("g.often > 0")
    keyed = found.select(F.col("stem").alias("short"), F.col("g.gram").alias("gram"))
    return keyed.join(long_grams.withColumnRenamed("stem", "long"), "gram").where((F.length("short") <= F.length("long")) & F.contains("long", "short")).select("short", "long")


# ---------------------------------------------------------------- scoring in batches


def _padded(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a matrix, and lengths."""
    n = np.array([len(x) for x in names], np.int64)
    out = np.zeros((len(names), int(n.max(initial=0))), np.uint32)
    for i, x in enumerate(names):
        out[i, : n[i]] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
    return out, n


def block_characters(first: list[str], second: list[str]) -> np.ndarray:
    """M of every pair (first[i], second[i]): characters in common blocks.

    Each round finds the longest block of every open stretch of all pairs at once (of equal
    ones the first in ``first``, then in ``second``) and opens what lies left and right of it."""
    a, n = _padded(first)
    b, m = _padded(second)
    common = np.zeros((len(first), b.shape[1]), bool)
    for i in np.flatnonzero(m >= LONG_NAME):
        values, at, count = np.unique(b[i, : m[i]], return_inverse=True, return_counts=True)
        common[i, : m[i]] = (count > m[i] // 100 + 1)[at]
    total = np.zeros(len(first), np.int64)
    who = np.arange(len(first))
    a_from, a_to, b_from, b_to = np.zeros_like(n), n.copy(), np.zeros_like(m), m.copy()
    while True:
        live = (a_to > a_from) & (b_to > b_from)
        who, a_from, a_to, b_from, b_to = who[live], a_from[live], a_to[live], b_from[live], b_to[live]
        if not len(who):
            return total
        wide, high = int((b_to - b_from).max()), int((a_to - a_from).max())
        j = np.arange(wide)
        at_b = np.minimum(b_from[:, None] + j, b.shape[1] - 1)
        own_b = b[who[:, None], at_b]
        open_b = (j < (b_to - b_from)[:, None]) & ~common[who[:, None], at_b]
        run = np.zeros((len(who), wide + 1), np.int32)
        size, i_end, j_end = np.zeros(len(who), np.int64), a_from.copy(), b_from.copy()
        for i in range(high):
            at_a = np.minimum(a_from + i, a.shape[1] - 1)
            equal = (own_b == a[who, at_a][:, None]) & open_b & (a_from + i < a_to)[:, None]
            run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
            best = run[:, 1:].argmax(axis=1)
            longest = run[np.arange(len(who)), best + 1]
            more = longest > size
            size[more], i_end[more], j_end[more] = longest[more], a_from[more] + i + 1, b_from[more] + best[more] + 1
        i0, j0 = i_end - size, j_end - size
        if common.any():  # characters that start no block still lengthen one
            while True:
                grow = (i0 > a_from) & (j0 > b_from)
                grow &= a[who, np.maximum(i0 - 1, 0)] == b[who, np.maximum(j0 - 1, 0)]
                if not grow.any():
                    break
                i0, j0, size = i0 - grow, j0 - grow, size + grow
            while True:
                grow = (i0 + size < a_to) & (j0 + size < b_to)
                grow &= a[who, np.minimum(i0 + size, a.shape[1] - 1)] == b[who, np.minimum(j0 + size, b.shape[1] - 1)]
                if not grow.any():
                    break
                size = size + grow
        np.add.at(total, who, size)
        hit = size > 0
        who, i0, j0, size = who[hit], i0[hit], j0[hit], size[hit]
        a_from, a_to = np.concatenate([a_from[hit], i0 + size]), np.concatenate([i0, a_to[hit]])
        b_from, b_to = np.concatenate([b_from[hit], j0 + size]), np.concatenate([j0, b_to[hit]])
        who = np.concatenate([who, who])


def similarity(first: list[str], second: list[str]) -> np.ndarray:
    """Similarity of every pair; contained names have at least ``CONTAINED``."""
    total = np.array([len(x) + len(y) for x, y in zip(first, second, strict=True)], float)
    ratio = np.where(total > 0, 2.0 * block_characters(first, second) / np.maximum(total, 1), 1.0)
    inside = np.array([x in y or y in x for x, y in zip(first, second, strict=True)], bool)
    return np.where(inside, np.maximum(ratio, CONTAINED), ratio)


def _best_of(first: list[str], second: list[str], names: list[str], who: np.ndarray, other: np.ndarray, bound: np.ndarray) -> dict[str, tuple[float, str]]:
    """Best (similarity, name) of every first name over the pairs (who[i], other[i]).

    The pairs of a name are scored from the highest bound down, in growing turns; one whose bound is
    below its name's best is not scored."""
    best: dict[str, tuple[float, str]] = {}
    known = np.full(len(first), -1.0)
    order = np.lexsort((-bound, who))
    who, other, bound = who[order], other[order], bound[order]
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
    done = 0
    while len(who):
        turn = rank < done + min(done + 1, 64)
        i, j = who[turn], other[turn]
        for lo in range(0, len(i), 2048):
            a, b = i[lo : lo + 2048].tolist(), j[lo : lo + 2048].tolist()
            for x, y, s in zip(a, b, similarity([first[x] for x in a], [second[y] for y in b]).tolist(), strict=True):
                had = best.get(first[x])
                if had is None or (-s, names[y]) < (-had[0], had[1]):
                    best[first[x]] = (s, names[y])
                    known[x] = s
        done += min(done + 1, 64)
        left = ~turn & (bound >= known[who] - 1e-12)
        who, other, bound, rank = who[left], other[left], bound[left], rank[left]
    return best


def common_subsequence(masks: np.ndarray, length: int, codes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a name of up to 64 characters with many: ``masks`` has
    the name's places of every code as bits, ``codes`` a column for each of the others."""
    open_ = np.full(codes.shape[1], ~np.uint64(0))
    for row in codes:
        hit = open_ & masks[row]
        open_ = (open_ + hit) | (open_ - hit)
    return np.bitwise_count(~open_ & np.uint64((1 << length) - 1)).astype(np.int64)


def near_pairs(first: list[str], second: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bound) of the pairs that may reach ``threshold``: by lengths, shared characters, then by the
    longest common subsequence, which holds all common blocks."""
    b, m = _padded(second)
    letters, codes = np.unique(b, return_inverse=True)
    codes = codes.reshape(b.shape).T  # a row for every place; beyond a name's end stands the code of 0
    codes = np.where(np.arange(b.shape[1])[:, None] < m, codes, len(letters)).astype(np.int32)
    small = np.min_scalar_type(int(max(m.max(initial=0), max(map(len, first), default=0))))
    has = np.zeros((len(letters), len(second)), small)
    for row in codes:
        real = row < len(letters)
        has[row[real], np.flatnonzero(real)] += 1
    at = {chr(c): i for i, c in enumerate(letters.tolist()) if c < 0x110000}
    who, other, bound = [], [], []
    for x, name in enumerate(first):
        total = len(name) + m
        need = np.ceil(total * (threshold / 2) - 1e-9)
        shared = np.zeros(len(second), np.int64)
        masks = np.zeros(len(letters) + 1, np.uint64)
        count: dict[int, int] = {}
        for place, c in enumerate(name):
            if c in at:
                count[at[c]] = count.get(at[c], 0) + 1
                if place < 64:
                    masks[at[c]] |= np.uint64(1 << place)
        for c, n in count.items():
            shared += np.minimum(has[c], small.type(n))
        kept = np.flatnonzero((shared >= need) & (m > 0) & (len(name) > 0))
        most = shared[kept]
        if len(name) <= 64 and len(kept):
            most = common_subsequence(masks, len(name), codes[: int(m[kept].max()), kept])
            still = most >= need[kept]
            kept, most = kept[still], most[still]
        high = 2.0 * most / total[kept]
        # a name can lie in the other only if all its characters are shared
        high = np.where(most == np.minimum(len(name), m[kept]), np.maximum(high, CONTAINED), high)
        who.append(np.full(len(kept), x))
        other.append(kept)
        bound.append(high)
    return (np.concatenate(who), np.concatenate(other), np.concatenate(bound)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def packed(names: DataFrame, cols: dict[str, str], size: int) -> DataFrame:
    """Names of like length in blocks: one row for up to ``size`` of them, with a list for each column."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                n = [len(x) for x in part.column(0).to_pylist()]
                lists = [pa.array([c.to_pylist()], pa.list_(pa.string())) for c in part.columns]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([min(n)], pa.int32()), pa.array([max(n)], pa.int32())], names=[*cols.values(), "least", "most"])

    schema = ", ".join([f"{c} array<string>" for c in cols.values()] + ["least int", "most int"])
    laid = names.select(*cols).where(F.length(next(iter(cols))) > 0).orderBy(F.length(next(iter(cols))), next(iter(cols)))
    return laid.mapInArrow(pack, schema)


def best_by_blocks(targets: DataFrame, files: DataFrame, threshold: float) -> DataFrame:
    """(a, s, name): the best files of the targets (column ``stem``) among ``files`` (b, name) by blocks in
    common; blocks of names meet where their lengths allow it, and a task returns one row a target and block."""
    blocks = packed(targets, {"stem": "first"}, TARGET_BLOCK).repartition(4 * targets.sparkSession.sparkContext.defaultParallelism)
    others = packed(files, {"b": "second", "name": "names"}, FILE_BLOCK).withColumnsRenamed({"least": "o_least", "most": "o_most"})
    # lengths n and m allow a similarity of 2 * min(n, m) / (n + m)
    ratio = (2 - threshold) / threshold + 1e-9
    met = blocks.join(others.hint("shuffle_replicate_nl"), (F.col("least") <= F.col("o_most") * ratio) & (F.col("o_least") <= F.col("most") * ratio))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first, second, names = (batch.column(i)[row].as_py() for i in range(3))
                best = _best_of(first, second, names, *near_pairs(first, second, threshold))
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array([v[0] for v in best.values()], pa.float64()), pa.array([v[1] for v in best.values()], pa.string())], names=["a", "s", "name"])

    return met.select("first", "second", "names").mapInArrow(compare, "a string, s double, name string")


def fuzzy_match(targets: DataFrame, files: DataFrame, target: str = "target", file: str = "file",
                threshold: float = THRESHOLD, target_stems: int = TARGET_STEMS) -> DataFrame:
    """(target, match, similarity) for every row of ``targets``: the image file whose stem is most
    similar to the target's, if it reaches ``threshold``; ties go to the smaller file name.

    A target without a match, or null, keeps its row with nulls; repeated targets keep theirs."""
    asked = targets.select(F.col(target).alias("target"), F.lower(stem(F.col(target), target_stems)).alias("stem"))
    images = files.where(F.col(file).rlike(ENDINGS)).groupBy(F.lower(stem(F.col(file))).alias("stem")).agg(F.min(file).alias("name"))
    images = cut_lineage(images)
    wanted = cut_lineage(asked.where(F.col("stem").isNotNull()).select("stem").distinct())
    names, stems = images.select(F.col("stem").alias("b"), "name"), images.select("stem")
    if threshold <= CONTAINED:
        # contained pairs whose lengths differ too much for the bound; their similarity is the fixed one
        inside = contained(wanted, stems).toDF("a", "b").unionAll(contained(stems, wanted).select("long", "short").toDF("a", "b"))
        inside = inside.where(least_shared(F.length("a") + F.length("b"), threshold) > F.least(F.length("a"), F.length("b")))
        flat = inside.join(names, "b").select("a", F.lit(CONTAINED).alias("s"), "name")
        empty = wanted.where("stem = ''").select(F.col("stem").alias("a"), F.lit(1).alias("one")).join(images.agg(F.min("name").alias("name")).withColumn("one", F.lit(1)), "one").where(F.col("name").isNotNull())
        flat = flat.unionByName(empty.select("a", F.lit(CONTAINED).alias("s"), "name"))
    scored = best_by_blocks(wanted, names, threshold).where(F.col("s") >= threshold)
    scored = scored.unionByName(flat) if threshold <= CONTAINED else scored
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("s")).alias("minus"), "name")).alias("m"))
    return asked.join(best.withColumnRenamed("a", "stem"), "stem", "left").select(F.col("target").alias(target), F.col("m.name").alias("match"), (-F.col("m.minus")).alias("similarity"))


def hybrid_match(targets: DataFrame, files: DataFrame, target: str = "target", file: str = "file",
                 threshold: float = THRESHOLD, near: float = NEAR) -> DataFrame:
    """(target, match, score, method) for every distinct target.

    A target with coordinates in its name takes the file nearest to them if it is closer than
    ``near``, else its fuzzy match, else the nearest file however far; one without coordinates has
    its fuzzy match alone.  ``score`` is the distance or the similarity, by ``method``
    (coordinates, fuzzy or none)."""
    asked = cut_lineage(targets.select(F.col(target).alias("target")).distinct())
    ra, dec = coord_from_name(F.col("target"))
    placed = asked.select("target", ra.alias("x"), dec.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    images = files.where(F.col(file).rlike(ENDINGS)).select(F.col(file).alias("file")).distinct()
    ra, dec = coord_from_name(F.col("file"))
    points = images.select("file", ra.alias("x"), dec.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    by_place = nearest_point(placed, points, "target", "x", "y", "file", "x", "y").select("target", F.col("file").alias("near_file"), "distance")
    by_place = cut_lineage(asked.join(by_place, asked["target"].eqNullSafe(by_place["target"]), "left").drop(by_place["target"]))
    # where coordinates decide, the name is not asked
    far = by_place.where(~F.coalesce(F.col("near_file").isNotNull() & (F.col("distance") < near), F.lit(False))).select("target")
    by_name = fuzzy_match(far, images, "target", "file", threshold)
    both = by_place.join(by_name, by_place["target"].eqNullSafe(by_name["target"]), "left").drop(by_name["target"])
    close = F.col("near_file").isNotNull() & (F.col("distance") < near)
    method = F.when(close, "coordinates").when(F.col("match").isNotNull(), "fuzzy").when(F.col("near_file").isNotNull(), "coordinates").otherwise("none")
    return both.withColumn("method", method).select(
        F.col("target").alias(target),
        F.when(F.col("method") == "coordinates", F.col("near_file")).otherwise(F.col("match")).alias("match"),
        F.when(F.col("method") == "coordinates", F.col("distance")).otherwise(F.col("similarity")).alias("score"), "method",
    )
