"""The adaptive quadtree: leaf sizes and nearest points against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbayes.operators import quadtree
from pairbayes.operators.match import nearest_point


def brute(queries, points):
    out = {}
    names = np.array([p for p, _, _ in points])
    xy = np.array([[x, y] for _, x, y in points])
    for q, x, y in queries:
        d2 = (xy[:, 0] - x) ** 2 + (xy[:, 1] - y) ** 2
        at = np.flatnonzero(d2 == d2.min())
        out[q] = (min(names[at]), float(np.sqrt(d2.min())))
    return out


def shapes():
    rng = np.random.default_rng(6)
    dense = np.vstack([rng.normal(size=(990, 2)) * 1e-7 + 0.3, rng.uniform(-1000, 1000, size=(10, 2))])  # 99 % in one place
    grid = np.array([[i % 20, i // 20] for i in range(600)], float)  # many ties
    line = np.c_[np.arange(400.0) ** 3, np.zeros(400)]
    far = np.vstack([rng.normal(size=(200, 2)), rng.normal(size=(200, 2)) + 1e9, [[1e300, -1e300]]])
    return {"dense": dense, "grid": grid, "line": line, "far": far, "one": np.array([[5.0, 5.0]]), "same": np.full((300, 2), 2.5)}


@pytest.mark.parametrize("shape", list(shapes()))
def test_nearest_equals_brute_force(spark, shape):
    xy = shapes()[shape]
    rng = np.random.default_rng(7)
    points = [(f"p{i:04d}", float(x), float(y)) for i, (x, y) in enumerate(xy)]
    asked = np.vstack([xy[rng.integers(0, len(xy), 60)], xy[rng.integers(0, len(xy), 60)] + rng.normal(size=(60, 2)) * np.ptp(xy[: len(xy) - 1] if len(xy) > 1 else xy) * 1e-3, rng.uniform(-2000, 2000, size=(20, 2)), [[0.5, 0.5], [9.5, 9.5]]])
    queries = [(f"q{i}", float(x), float(y)) for i, (x, y) in enumerate(asked)]
    p = spark.createDataFrame([*points, ("a", None, 1.0), ("b", float("nan"), 0.0), ("c", float("inf"), 0.0)], "p string, x double, y double")
    q = spark.createDataFrame([*queries, ("null", None, 0.0), ("nan", float("nan"), 0.0)], "q string, x double, y double").withColumn("u", F.lit("clash"))
    got = {r.q: (r.p, r.distance) for r in nearest_point(q, p, "q", "x", "y", "p", "x", "y", leaf=8).collect()}
    want = brute(queries, points)
    assert got.pop("null") == (None, None) and got.pop("nan") == (None, None)
    assert got.keys() == want.keys()
    for k, (name, d) in want.items():
        assert got[k][0] == name and got[k][1] == pytest.approx(d)


def test_a_dense_place_has_no_large_leaf(spark):
    xy = shapes()["dense"]
    points = spark.createDataFrame([(float(x), float(y), i) for i, (x, y) in enumerate(xy)], "px double, py double, pid long")
    held, nodes = quadtree.build(points, leaf=16)
    sizes = [r["count"] for r in held.groupBy(*quadtree.CELL).count().collect()]
    assert sum(sizes) == len(xy) and max(sizes) <= 16
    assert nodes.where("is_leaf").count() == len(sizes)
    assert nodes.groupBy(*quadtree.CELL).count().where("count > 1").isEmpty()
