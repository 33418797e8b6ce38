"""Fuzzy and hybrid name matching against all pairs scored by the standard library's matcher."""

import math
import random
from difflib import SequenceMatcher
from pathlib import PurePosixPath

import pytest

from pairbayes.operators import names as N


def plain(a, b):
    s = SequenceMatcher(None, a, b).ratio()
    return max(s, 0.8) if a in b or b in a else s


def stems(x, times):
    for _ in range(times):
        x = PurePosixPath(x).stem
    return x.lower()


def test_blocks_equal_the_plain_matcher():
    rng = random.Random(3)
    first, second = [], []
    for t in range(600):
        letters = "abcdefghij"[: rng.choice([1, 2, 4, 10])]
        a = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 20, 30])))
        b = "".join(rng.choices(letters, k=rng.choice([0, 3, 18, 30])))
        if t % 3 == 0:
            b = a[:7] + b[:2] + a[5:]
        if t % 20 == 0:  # long names: frequent characters start no block
            b = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=230)) + a
        first.append(a)
        second.append(b)
    assert N.similarity(first, second).tolist() == pytest.approx([plain(a, b) for a, b in zip(first, second)], abs=1e-12)


def _names(rng, n):
    words = ["ring", "galaxy", "spiral", "edge", "disk", "halo", "sdss", "img", "field", "star"]
    return ["_".join(rng.choices(words, k=rng.randint(1, 3))) + str(rng.randint(0, 500)) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_fuzzy_match_equals_all_pairs(spark, threshold):
    rng = random.Random(9)
    targets = [x + rng.choice([".jpg", "", ".a.b.jpg"]) for x in _names(rng, 1000)] + ["a", "", "x.jpg", "ring", "no such name at all, zzz"]
    files = [x + rng.choice([".jpg", ".PNG", ".txt"]) for x in _names(rng, 1000)]
    files += ["q.jpg", "dir/sub/ring7.jpeg", "ring_halo_disk_field_star_edge_spiral_galaxy_x.jpeg"]
    t = spark.createDataFrame([(x, 1) for x in targets] + [(None, 2)], "target string, match int")
    f = spark.createDataFrame([(x, "extra") for x in [*files, files[0], None]], "file string, name string")
    got = N.fuzzy_match(t, f, threshold=threshold).collect()
    images = sorted({x for x in files if x.lower().endswith((".jpg", ".jpeg", ".png"))})
    want = {None: (None, None)}
    for x in set(targets):
        s, name = min((-plain(stems(x, 3), stems(y, 1)), y) for y in images)
        want[x] = (name, -s) if -s >= threshold else (None, None)
    assert sorted(str(r.target) for r in got) == sorted(str(x) for x in [*targets, None])
    assert all((r.match, r.similarity) == want[r.target] for r in got)


def test_filter_loses_no_pair(spark):
    rng = random.Random(5)
    a, b = sorted({*_names(rng, 300), "é" * 5, "ab"}), sorted({*_names(rng, 300), "éé", "ba"})
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "stem string")
    rows = N.candidates(frame(a), frame(b), 0.6).collect()
    found = {(r.a, r.b) for r in rows}
    assert len(found) == len(rows) < 0.25 * len(a) * len(b)
    assert all((x, y) in found for x in a for y in b if SequenceMatcher(None, x, y).ratio() >= 0.6)


def test_contained_names(spark):
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "stem string")
    rng = random.Random(8)
    short = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(80)} | {"zz"})
    long = sorted({"".join(rng.choices("abc", k=rng.randint(1, 40))) for _ in range(80)})
    got = [tuple(r) for r in N.contained(frame(short), frame(long)).collect()]
    assert sorted(got) == sorted((s, x) for s in short for x in long if s in x)


def test_hybrid_rule(spark):
    files = ["ring_10.00_20.00.jpg", "ring_50.00_20.00.jpg", "alphabet.jpg", "notes.txt"]
    targets = ["ring_10.30_20.40.png", "alphabex_30.00_20.00.png", "wwww_40.00_20.00.png", "alphabets", "qqqq", None]
    f = spark.createDataFrame([(x,) for x in files], "file string")
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    got = {r.target: (r.match, r.score, r.method) for r in N.hybrid_match(t, f).collect()}
    assert got["ring_10.30_20.40.png"] == ("ring_10.00_20.00.jpg", pytest.approx(0.5), "coordinates")
    name, score, method = got["alphabex_30.00_20.00.png"]
    assert (name, method) == ("alphabet.jpg", "fuzzy") and score == pytest.approx(plain(stems("alphabex_30.00_20.00.png", 3), "alphabet"))
    assert got["wwww_40.00_20.00.png"] == ("ring_50.00_20.00.jpg", pytest.approx(10.0), "coordinates")
    assert got["alphabets"][2] == "fuzzy" and got["qqqq"] == (None, None, "none") and got[None] == (None, None, "none")
    empty = spark.createDataFrame([], "file string")
    assert {r.method for r in N.hybrid_match(t, empty).collect()} == {"none"}
    assert math.isclose(N.similarity(["abcd"], ["abxd"])[0], 0.75)


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85])
def test_near_pairs_keep_all_that_reach_the_threshold(threshold):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("ab_é𝄞", k=n))
    first = ["", "a", "x" * 64, "ab" * 32, word(64), word(65), word(90)] + [word(rng.randint(1, 30)) for _ in range(40)]
    second = ["", "b", "x" * 63 + "y", word(64) + "q", word(120)] + first[4:9] + [x[2:] + x[:2] + word(3) for x in first[7:]]
    i, j, bound = N.near_pairs(first, second, threshold)
    found = dict(zip(zip(i.tolist(), j.tolist()), bound.tolist()))
    assert len(found) == len(i) < len(first) * len(second)
    for x, a in enumerate(first):
        for y, b in enumerate(second):
            s = plain(a, b)
            if a and b and N.block_characters([a], [b])[0] * 2 / (len(a) + len(b)) >= threshold:
                assert found[x, y] >= s - 1e-12
            if (x, y) in found and len(a) <= 64 and a not in b and b not in a:
                assert found[x, y] == max(2 * _subsequence(a, b) / (len(a) + len(b)), 0.8 if _subsequence(a, b) == min(len(a), len(b)) else 0)


@pytest.mark.parametrize("sizes", [(3, 5), (128, 4096)])
def test_blocks_of_any_size_match_alike(spark, monkeypatch, sizes):
    monkeypatch.setattr(N, "TARGET_BLOCK", sizes[0])
    monkeypatch.setattr(N, "FILE_BLOCK", sizes[1])
    rng = random.Random(8)
    targets, files = [x + ".jpg" for x in _names(rng, 60)], [x + ".png" for x in _names(rng, 90)]
    got = N.fuzzy_match(spark.createDataFrame([(x,) for x in targets], "target string"), spark.createDataFrame([(x,) for x in files], "file string")).collect()
    for r in got:
        s, name = min((-plain(stems(r.target, 3), stems(y, 1)), y) for y in files)
        assert (r.match, r.similarity) == ((name, -s) if -s >= 0.6 else (None, None))


def test_names_are_asked_only_where_no_file_is_near(spark, monkeypatch):
    asked, real = [], N.fuzzy_match

    def seen(targets, *more):
        asked.extend(r.target for r in targets.collect())
        return real(targets, *more)

    monkeypatch.setattr(N, "fuzzy_match", seen)
    targets = ["ring_1.25_2.5.png", "ring_50.0_60.0.png", "ring.png", "zzz_90.0_80.0.png", None]
    files = ["ring_1.75_2.5.jpg", "ring_50.0_60.0_.jpg", "other_51.0_61.0.jpg"]
    frame = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    got = {r.target: (r.match, r.method) for r in N.hybrid_match(frame(targets, "target"), frame(files, "file")).collect()}
    assert sorted(asked, key=str) == [None, "ring.png", "zzz_90.0_80.0.png"]
    assert got["ring_1.25_2.5.png"] == ("ring_1.75_2.5.jpg", "coordinates") and got[None] == (None, "none") and len(got) == 5
