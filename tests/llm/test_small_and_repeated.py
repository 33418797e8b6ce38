"""Few labels a class, and repeated query rows."""

import numpy as np
import pytest

from pairbayes.llm import perm_index, quality
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [1, 2, 4, 5])
def test_few_labels_give_finite_scores(spark, n):
    good, bad = "a quiet river runs past the old mill", "click buy now free free offer"
    docs = spark.createDataFrame([(i, good if i < n else bad) for i in range(2 * n)] + [(99, ""), (100, None), (101, good + " again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(2 * n)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, quality.fit(docs, labels)).collect()}
    assert len(scores) == 2 * n + 3 and all(0 <= s <= 1 for s in scores.values())
    assert scores[0] > scores[n]


def test_repeated_query_rows_lose_no_neighbour(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [rows[0]] * 7 + [rows[3]] * 5 + [(20, rng.normal(size=8).tolist())]  # equal rows; an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in perm_index.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    distinct = list({(i, tuple(v)) for i, v in rows})
    for q in range(0, 400, 20):
        for v in [v for i, v in distinct if i == q]:
            best = sorted(((-float(np.dot(v, w)), i) for i, w in distinct if i != q))[:10]
            want = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
            found = [(a, b) for a, b, _ in got[q]]
            assert all((a, b) in found for a, b, _ in want)
        assert len(got[q]) == 10 * len([v for i, v in distinct if i == q])
