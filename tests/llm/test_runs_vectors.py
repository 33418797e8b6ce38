"""Runs of words, int8 tiles and cover trees against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbayes.llm import cover_tree, queries, runs, tile_dedup

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- runs


def lyndon_by_suffixes(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def runs_by_hand(w, exponent, least):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            seg = w[i : j + q]
            if j > i and len(seg) >= max(least, exponent * q) and all(seg[r:] != seg[:-r] for r in range(1, q)):
                out.add((i, len(seg), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_grouping_and_runs(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randint(0, k) for _ in range(n)]
        if rng.random() < 0.6:
            w = (w[: rng.randint(0, 5)] + [rng.randint(0, k) for _ in range(rng.randint(1, 6))] * 10 + w)[: n + 20]
        assert runs.lyndon_lengths(w) == lyndon_by_suffixes(w)
        for e, least in ((3, 6), (4, 6), (6, 6), (4, 3)):
            assert runs.runs_of(w, e, least) == runs_by_hand(w, e, least)


def test_long_and_repeating_words():
    assert runs.runs_of(["a"] * 50_000) == [(0, 50_000, 1)]
    assert runs.runs_of([*"xy", *(["p", "q", "r"] * 3000), "x"]) == [(2, 9000, 3)]
    assert runs.runs_of(["a"] * 5) == [] and runs.runs_of([]) == []
    with pytest.raises(ValueError):
        runs.runs_of(["a"] * 9, exponent=2)


def test_runs_edge_rows(spark, edge, none):
    odd = edge.withColumns({"runs": F.lit(1), "record": F.lit("x"), "collapsed": F.lit(None).cast("string")})
    rows = runs.find_runs(odd).collect()
    assert len(rows) == edge.count() and {r["record"]["record"] for r in rows} == {"x"}
    for r in rows:
        words = (r["record"]["text"] or "").encode().split()
        assert r["n_words"] == len(words)
        if not r["runs"]:
            assert r["collapsed"].encode() == b" ".join(words)
    assert runs.find_runs(none).collect() == []


def test_runs_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_baier_runs(spark, SF).collect():
        w = (texts[r["doc_id"]] or "").encode().split()
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1200:
            continue
        found = runs_by_hand(w, 4, 6)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


# ---------------------------------------------------------------- int8 tiles


def classes(ids, linked):
    out = [None] * len(ids)
    for s in range(len(ids)):
        if out[s] is None:
            todo, seen = [s], {s}
            while todo:
                for v in np.flatnonzero(linked[todo.pop()]):
                    if v not in seen:
                        seen.add(int(v))
                        todo.append(int(v))
            known = [ids[v] for v in seen if ids[v] is not None]
            for v in seen:
                out[v] = min(known) if known else "none"
    return out


def test_error_bound_holds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24)) * rng.choice([1e-200, 1, 1e150], size=(300, 1))
    u = tile_dedup.unit(x)
    codes, scale, error = tile_dedup.quantised(u)
    back = codes * scale[:, None]
    bound = error[:, None] + (1 + error[:, None]) * error[None, :] + tile_dedup.SLACK
    assert (np.abs(back @ back.T - u @ u.T) <= bound).all()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_tiles_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(tile_dedup, "GROUP", 200)
    monkeypatch.setattr(tile_dedup, "TILE", 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 16))
    for a in range(0, 300, 20):  # groups around the threshold
        x[a : a + 20] = x[a] + rng.normal(size=(20, 16)) * rng.choice([0.1, 0.3, 0.35, 0.5], size=(20, 1))
    x[400:460] = x[399]
    x[500] = 0
    if kind == "float":
        x = x.astype(np.float32).astype(float)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(700), x)]
    rows += [(900, None), (901, []), (902, [None, 1.0]), (903, [float("nan")] * 16), (904, [1.0, 2.0]), (None, x[399].tolist()), rows[399]]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"n_links": F.lit(9), "record": F.lit(1), "node": F.lit("n")})
    good = [v is not None and len(v) == 16 and not any(c is None or not np.isfinite(c) for c in v) and any(v) for _, v in rows]
    u = np.zeros((len(rows), 16))
    for k, (_, v) in enumerate(rows):
        if good[k]:
            u[k] = np.array(v) / np.linalg.norm(v)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    want = classes([i for i, _ in rows], linked)
    expected = sorted((str(i), int(linked[k].sum()), str(want[k])) for k, (i, _) in enumerate(rows))
    got = tile_dedup.near_vectors(df).collect()
    assert sorted((str(r["id"]), r["n_links"], str(r["component_id"])) for r in got) == expected
    assert all(r["kept"] == (r["id"] is not None and r["id"] == r["component_id"]) for r in got)


def test_tiles_without_ids_or_rows(spark):
    kind = "vec_id long, embedding array<double>"
    near = [(None, [1.0, 0.01 * k]) for k in range(5)]
    rows = tile_dedup.near_vectors(spark.createDataFrame(near, kind)).collect()
    assert [r["n_links"] for r in rows] == [4] * 5 and sum(r["kept"] for r in rows) == 1
    assert tile_dedup.near_vectors(spark.createDataFrame([], kind)).collect() == []
    assert [tuple(r)[1:] for r in tile_dedup.near_vectors(spark.createDataFrame([(4, None)], kind)).collect()] == [(4, 0, 4, True)]


# ---------------------------------------------------------------- cover trees


def triples(rows, positives=5, negatives=5):
    rows = [r for r in dict.fromkeys(rows)]
    out = []
    for a, label, x in rows:
        if a % 10:
            continue
        score = lambda r: sum(int(p) * int(q) for p, q in zip(r[2], x))  # noqa: B023, E731
        others = sorted(((-score(r), r[0], r[1]) for r in rows if r[0] != a and len(r[2]) == len(x)), key=lambda t: t[:2])
        for minus, p, _ in [o for o in others if o[2] == label][:positives]:
            ps = -minus
            hard = [o for o in others if o[2] != label and 80 * ps <= -100 * o[0] <= 100 * ps][:negatives]
            out += [(a, p, k + 1, o[1], ps, -o[0]) for k, o in enumerate(hard)]
    return sorted(out)


def test_tree_covers_and_bounds():
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.concatenate([rng.normal(size=(400, 8)), rng.normal(size=(1, 8)) + 0.01 * rng.normal(size=(300, 8)), np.zeros((50, 8)), np.repeat(rng.normal(size=(1, 8)), 200, 0)]))
    tree = cover_tree.CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    q = np.floor(256 * rng.normal(size=(20, 8)))
    score, nodes = q @ x.T, np.arange(len(tree.rows))
    low, high = tree.bounds(nodes, q @ x[tree.rows].T, np.sqrt((q * q).sum(axis=1)))
    for k in nodes:
        under = tree.order[tree.start[k] : tree.end[k]]
        assert tree.rows[k] in under
        assert (score[:, under] >= low[:, [k]]).all() and (score[:, under] <= high[:, [k]]).all()


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 100)
    monkeypatch.setattr(cover_tree, "QUERIES", 8)
    rng = np.random.default_rng(11)
    rows = [(i, str(rng.integers(0, 3)), tuple(rng.integers(-3, 4, size=4).tolist())) for i in range(400)]  # many ties
    rows += [(1000 + i, "1", (2, 2, 2, 2)) for i in range(300)] + [(2000 + i, str(i % 3), (0, 0, 0, 0)) for i in range(20)]
    rows += [(3000 + i, "0", (1, 2)) for i in range(10)] + rows[:5] + [(10, "0", (1, 1, 1, 1)), (10, "1", (1, 1, 1, 2))]
    table = [(i, y, [float(v) for v in x]) for i, y, x in rows]
    table += [(None, "1", [1.0] * 4), (20, None, [1.0] * 4), (30, "1", None), (40, "1", []), (50, "1", [1.0, None, 1.0, 1.0]), (60, "1", [float("inf")] * 4)]
    df = spark.createDataFrame(table, "vec_id long, label string, embedding array<double>").withColumns({"key": F.lit(1), "score": F.lit("s"), "rank": F.lit(0)})
    got = sorted(tuple(r) for r in cover_tree.hard_negatives(df, lambda i: i % 10 == 0).collect())
    assert got == triples(rows)


def test_negatives_of_nothing(spark):
    kind = "vec_id long, label int, embedding array<double>"
    assert cover_tree.hard_negatives(spark.createDataFrame([], kind), lambda i: i % 10 == 0).collect() == []
    alone = spark.createDataFrame([(10, 1, [1.0]), (20, 2, [1.0])], kind)
    assert cover_tree.hard_negatives(alone, lambda i: i % 10 == 0).collect() == []
    far = spark.createDataFrame([(10, 1, [2.0**30]), (20, 1, [2.0**30])], kind)
    with pytest.raises(Exception, match="2\\^53"):
        cover_tree.hard_negatives(far, lambda i: i % 10 == 0).collect()
