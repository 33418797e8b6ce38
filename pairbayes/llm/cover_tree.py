"""Hard negatives by exact inner-product search in cover trees.

Candidates are lifted: one more component, sqrt(M^2 - |x|^2) with M the longest in the
tree, puts them all on a sphere, and inner products with a query (lifted by 0) become
angles.  Blocks of at most ``BLOCK`` rows, sorted by label and nearest pivot, each hold a
cover tree: from level to level the radius halves, the centres of a level stand further
apart than its radius and cover the members of the node above, and a node's first child
has the node's own centre.  Every node keeps the true largest angle to its members, so

    |q| M cos(theta + omega)  <=  <q, x>  <=  |q| M cos(theta - omega)

for each x below it.  A block of queries descends level by level.  A node is left as soon
as its interval misses the query's score window or cannot reach the k-th best that is
already known (the centres on the way down are candidates themselves).  Leaves are
visited by their best upper bound and verified on whole numbers, so results are exact.

Two searches make the triples: the best rows of the anchor's label, then, in the window
that each positive's score spans, the best rows of other labels.  A task holds one tree
and streams blocks of queries past it; it returns ``k`` rows a query.

Results on unusual input: rows with a null id, label or vector, an empty vector, or a
null or non-finite component take no part.  Repeated rows (same id, label and vector)
count once.  Rows that share the anchor's id are not its candidates; an id with several
labels or vectors is an anchor for each.  Vectors of unequal length are not compared.
Ties go to the smaller id.  Extra columns do not matter; an empty table gives an empty
table.  Scores are exact as long as |a| * |b| stays below 2^53, else an error is raised."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbayes.llm.common import give_back, stash
from pairbayes.llm.tile_dedup import with_pivot

BLOCK, LEAF, QUERIES, STREAM, MOST_TASKS = 4096, 32, 512, 64, 20_000
EXACT = float(2**53)


# ---------------------------------------------------------------- one tree


class CoverTree:
    """Nodes in level order; the members of a node are a stretch of the ordered rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        n, square = len(x), (x * x).sum(axis=1)
        self.most = float(np.sqrt(square.max())) if n else 0.0
        lifted = np.c_[x, np.sqrt(np.maximum(square.max() - square, 0))]
        order = np.arange(n)
        centre, start, end, first, count, chord = [0], [0], [n], [0], [0], [self._reach(lifted, order, 0)]
        # row numbers of the centres refer to the input until the order is final
        level, radius = [0], 2 * self.most
        while level:
            radius /= 2
            below = []
            for node in level:
                a, b = start[node], end[node]
                if b - a <= leaf or chord[node] <= 0:
                    continue
                members = order[a:b]
                net, owner = self._net(lifted, members, centre[node], radius)
                if len(net) == 1 and radius > chord[node]:
                    below.append(node)  # nothing to part at this radius
                    continue
                rank = np.argsort(owner, kind="stable")
                order[a:b] = members[rank]
                sizes = np.bincount(owner, minlength=len(net))
                first[node], count[node] = len(centre), len(net)
                for c, size in zip(net, sizes.tolist(), strict=True):
                    centre.append(int(c))
                    start.append(a)
                    end.append(a + size)
                    first.append(0)
                    count.append(0)
                    chord.append(self._reach(lifted, order[a : a + size], int(c)))
                    if size > leaf:
                        below.append(len(centre) - 1)
                    a += size
            level = below if radius > 1e-12 * max(self.most, 1) else []
        self.order = order
        self.start, self.end = np.array(start), np.array(end)
        self.first, self.count = np.array(first), np.array(count)
        self.rows = np.array(centre)
        half = np.minimum(1, np.array(chord) / (2 * self.most or 1)) * (1 + 1e-12)
        angle = 2 * np.arcsin(np.minimum(1, half))
        self.cos, self.sin = np.cos(angle), np.sin(angle)

    @staticmethod
    def _reach(lifted: np.ndarray, members: np.ndarray, centre: int) -> float:
        return float(np.sqrt(((lifted[members] - lifted[centre]) ** 2).sum(axis=1).max())) if len(members) else 0.0

    @staticmethod
    def _net(lifted: np.ndarray, members: np.ndarray, centre: int, radius: float) -> tuple[list[int], np.ndarray]:
        """Centres further apart than ``radius`` that cover the members, the given one first, and
        each member's nearest of them."""
        points = lifted[members]
        length = (points * points).sum(axis=1)
        best, owner = np.full(len(members), np.inf), np.zeros(len(members), np.int64)
        net, at = [], int(np.flatnonzero(members == centre)[0])
        while True:
            apart = length - 2 * (points @ points[at]) + length[at]
            apart[at] = 0
            nearer = apart < best
            owner[nearer] = len(net)
            best[nearer] = apart[nearer]
            net.append(int(members[at]))
            open_ = best > radius * radius
            at = int(open_.argmax())
            if not open_[at]:
                return net, owner

    def bounds(self, nodes: np.ndarray, score: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of any member of the nodes, from the scores of their centres."""
        whole = (length * self.most)[:, None]
        c = np.clip(score / np.maximum(whole, 1e-300), -1, 1)
        s = np.sqrt(1 - c * c)
        cos, sin = self.cos[nodes], self.sin[nodes]
        low = np.where(c <= -cos, -1.0, c * cos - s * sin)
        high = np.where(c >= cos, 1.0, c * cos + s * sin)
        slack = 1e-7 * whole + 1e-6  # the square root loses half the digits near an angle of 0
        return low * whole - slack, high * whole + slack


class Best:
    """The ``k`` best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, right: np.ndarray, ids: np.ndarray) -> None:
        """``score`` (queries x rows), where ``right`` says so."""
        right = right & (score >= self.least[:, None])
        if not right.any():
            return
        q, j = np.nonzero(right)
        query, s, i = np.concatenate([self.query, q]), np.concatenate([self.score, score[q, j]]), np.concatenate([self.id, ids[j]])
        order = np.lexsort((i, -s, query))
        query, s, i = query[order], s[order], i[order]
        new = np.flatnonzero(np.diff(query, prepend=-1) != 0)
        place = np.arange(len(query)) - np.repeat(new, np.diff(new, append=len(query)))
        keep = place < self.k
        last = place == self.k - 1
        self.least[query[last]] = s[last]
        self.query, self.score, self.id = query[keep], s[keep], i[keep]


def search(tree: CoverTree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, asked: dict, same: bool, k: int) -> Best:
    """Best ``k`` rows of the tree for each query, in its window [low, high] and of its label
    (``same``) or another one.  ``x``, ``ids`` and ``labels`` are the tree's rows."""
    q, low, high = asked["vectors"], asked["low"], asked["high"]
    length = np.sqrt((q * q).sum(axis=1))
    best = Best(len(q), k)
    fits = lambda rows: ((labels[rows][None, :] == asked["labels"][:, None]) == same) & (ids[rows][None, :] != asked["ids"][:, None])
    within = lambda score: (score >= low[:, None]) & (score <= high[:, None])
    nodes, open_ = np.zeros(1, np.int64), np.ones((len(q), 1), bool)
    leaves, reach = [], []
    while len(nodes):
        centre = tree.rows[nodes]
        score = q @ x[centre].T
        least, most = tree.bounds(nodes, score, length)
        open_ &= (most >= low[:, None]) & (least <= high[:, None]) & (most >= best.least[:, None])
        if len(nodes) >= k:  # centres are rows: the k-th best of them is a bound for what follows
            known = np.where(fits(centre) & within(score), score, -np.inf)
            np.maximum(best.least, np.partition(known, len(nodes) - k, axis=1)[:, len(nodes) - k], out=best.least)
        ends = tree.count[nodes] == 0
        leaves.append(nodes[ends])
        reach.append(np.where(open_[:, ends], most[:, ends], -np.inf))
        inner = np.flatnonzero(~ends & open_.any(axis=0))
        times = tree.count[nodes[inner]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        open_ = np.repeat(open_[:, inner], times, axis=1)
        nodes = np.repeat(tree.first[nodes[inner]], times) + step
    leaf, most = np.concatenate(leaves), np.concatenate(reach, axis=1)
    # best first: the leaves that any query may find its best in
    turn = np.argsort(-most.max(axis=0, initial=-np.inf), kind="stable")
    size = (tree.end - tree.start)[leaf[turn]]
    for part in np.split(turn, np.searchsorted(np.cumsum(size), np.arange(1024, size.sum(), 1024))):
        live = most[:, part] >= np.maximum(best.least, -1e300)[:, None]
        use = live.any(axis=0)
        who = np.flatnonzero(live.any(axis=1))
        if not len(who):
            continue
        part, live = part[use], live[:, use]
        times = (tree.end - tree.start)[leaf[part]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows = tree.order[np.repeat(tree.start[leaf[part]], times) + step]
        score = np.full((len(q), len(rows)), -np.inf)
        score[who] = q[who] @ x[rows].T
        best.add(score, np.repeat(live, times, axis=1) & fits(rows) & within(score), ids[rows])
    return best


# ---------------------------------------------------------------- on Spark

PACK = "place long, dims int, labels array<string>, n int, ids binary, of binary, vectors binary, low binary, high binary, keys binary, tree binary"


def packed(rows: DataFrame, parts: int, limit: int) -> DataFrame:
    """Rows (key, id, label, vector, low, high), near ones together, as written packs of at most ``limit`` rows of one length."""
    placed = with_pivot(rows)
    near = placed.repartitionByRange(parts, "dims", "label", "near", F.xxhash64("vector", "id")).sortWithinPartitions("dims", "label", "near", F.xxhash64("vector", "id"), "id", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            nonlocal serial, held, n
            t = pa.Table.from_batches(held)
            held, n = [], 0
            names, of = np.unique(np.array(t.column("label").to_pylist(), object), return_inverse=True)
            cols = {c: np.ascontiguousarray(t.column(c).to_numpy()) for c in ("id", "low", "high", "key")}
            x = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            row = {"place": serial, "dims": t.column("dims")[0].as_py(), "labels": names.tolist(), "n": t.num_rows, "ids": cols["id"].tobytes(), "of": of.astype("<i4").tobytes(), "vectors": np.ascontiguousarray(x, "<f8").tobytes(), "low": cols["low"].tobytes(), "high": cols["high"].tobytes(), "keys": cols["key"].tobytes()}
            serial += 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("place", pa.int64()), ("dims", pa.int32()), ("labels", pa.list_(pa.string())), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "of", "vectors", "low", "high", "keys", "tree")]]))

        for batch in batches:
            dims, a = batch.column(batch.schema.get_field_index("dims")).to_numpy(), 0
            while a < len(dims):
                if held and (n >= limit or held[-1].column(held[-1].schema.get_field_index("dims"))[0].as_py() != dims[a]):
                    yield out()
                other = np.flatnonzero(dims[a:] != dims[a])
                b = min(a + (int(other[0]) if len(other) else len(dims) - a), a + limit - n)
                held.append(batch.slice(a, b - a))
                n, a = n + b - a, b
        if held:
            yield out()
        give_back()

    return stash(near.mapInArrow(run, PACK))


def unpacked(row: dict) -> dict:
    read = lambda name, t: np.frombuffer(row[name], t)
    names = np.array(row["labels"], object)
    return {"ids": read("ids", "<i8"), "labels": names[read("of", "<i4")], "vectors": read("vectors", "<f8").reshape(row["n"], row["dims"]), "low": read("low", "<f8"), "high": read("high", "<f8"), "keys": read("keys", "<i8")}


def best_rows(trees: DataFrame, asked: DataFrame, n_asked: int, same: bool, k: int) -> DataFrame:
    """(key, score, id, rank): the ``k`` best candidates of every query, exactly."""
    parts = -(-n_asked // QUERIES)
    blocks = packed(asked, parts, QUERIES)
    salts = -(-parts // STREAM)
    # which block meets which tree: by their labels and lengths alone, on small rows; blocks are numbered by their partition
    told = blocks.select("place", F.shiftright("place", 32).alias("part"), F.col("dims").alias("q_dims"), F.col("labels").alias("q_labels"))
    apart = trees.select(F.col("place").alias("tree_place"), "dims", F.col("labels").alias("t_labels")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    useful = F.arrays_overlap("q_labels", "t_labels") if same else (F.size(F.array_union("q_labels", "t_labels")) > 1)
    pairs = stash(apart.join(told, "part").where((F.col("dims") == F.col("q_dims")) & useful).select("tree_place", "place", F.pmod("part", F.lit(salts)).alias("salt")))
    columns = ["dims", "labels", "n", "ids", "of", "vectors", "low", "high", "keys"]
    sent = pairs.join(blocks, "place").select("tree_place", "salt", F.lit(1).alias("kind"), "place", *columns)
    held = pairs.select("tree_place", "salt").distinct().join(trees.withColumnRenamed("place", "tree_place"), "tree_place").select("tree_place", "salt", F.lit(0).alias("kind"), F.col("tree_place").alias("place"), *columns)
    tasks = max(1, min(held.count(), MOST_TASKS))
    dealt = held.unionByName(sent).repartition(tasks, "tree_place", "salt").sortWithinPartitions("tree_place", "salt", "kind", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        tree, own = None, {}
        for row in rows:
            now = unpacked(row)
            if row["kind"] == 0:
                tree, own = CoverTree(now["vectors"]), now
                continue
            widest = float(np.sqrt((now["vectors"] ** 2).sum(axis=1).max()))
            if widest * tree.most >= EXACT:
                raise ValueError("scores beyond 2^53 are not exact")
            found = search(tree, own["vectors"], own["ids"], own["labels"], now, same, k)
            yield pa.RecordBatch.from_arrays([pa.array(now["keys"][found.query]), pa.array(found.score.astype(np.int64)), pa.array(found.id)], names=["key", "score", "id"])
        give_back()

    near = dealt.mapInArrow(run, "key long, score long, id long")
    # at most k rows a key and task reach the window: ranks up to k are limited before the shuffle
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def hard_negatives(rows: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose
    id passes ``is_anchor``: their best ``positives`` rows of the same label, and for each the best
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` per cent of the positive's.
    Components are whole numbers."""
    number = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    good = number.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")).distinct()
    wide = F.lit(float("inf"))
    good = stash(good.select(F.monotonically_increasing_id().alias("key"), "id", "label", "vector", (-wide).alias("low"), wide.alias("high")))
    anchors = good.where(F.coalesce(is_anchor(F.col("id")), F.lit(False)))
    n, asked = good.count(), anchors.count()
    if not asked:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    trees = packed(good, -(-n // BLOCK), BLOCK)
    first = stash(best_rows(trees, anchors, asked, True, positives).select(F.col("key").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    floor = lambda x: (x - F.pmod(x, F.lit(100))) / 100  # noqa: E731  whole: no digit is lost
    windows = first.select("anchor", "positive_score").distinct().select("anchor", "positive_score", (-floor(-F.col("positive_score") * low)).alias("low"), floor(F.col("positive_score") * high).alias("high"))
    windows = stash(windows.where("low <= high").withColumn("key", F.monotonically_increasing_id()))
    wanted = windows.join(anchors.select(F.col("key").alias("anchor"), "id", "label", "vector"), "anchor")
    n_windows = windows.count()
    result = anchors.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id")).join(first, "anchor")
    if not n_windows:
        return result.limit(0).select("anchor_id", "positive_id", F.lit(1).alias("rank"), F.col("positive_id").alias("negative_id"), "positive_score", F.col("positive_score").alias("negative_score"))
    second = best_rows(trees, wanted.select("key", "id", "label", "vector", "low", "high"), n_windows, False, negatives)
    second = second.join(windows.select("key", "anchor", "positive_score"), "key").select("anchor", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return result.join(second, ["anchor", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
