"""The registered queries and the pipeline on a small table."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairbayes.llm import queries

SF = "/root/testdata/sf0.001"
CONTRACT = {
    1: ["doc_id", "held_out", "score", "predicted"], 2: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    3: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], 4: ["doc_id", "license"], 5: ["doc_id", "n_shingles", "component_id", "kept"],
    6: ["query_id", "rank", "vec_id", "score"], 7: ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    8: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], 9: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    10: ["doc_id", "size", "source_size", "target", "taken"], 11: ["vec_id", "n_links", "component_id", "kept"],
    12: ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    13: ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_columns_and_rows(spark, name):
    n = int(name[2:].split("_")[0])
    df = queries.QUERIES[name](spark, SF)
    assert set(CONTRACT[n]) <= set(df.columns)
    rows = df.collect()
    if n not in (6, 9, 11, 13):
        assert sorted(r["doc_id"] for r in rows) == list(range(200))
    if n == 7:
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        order = sorted(texts, reverse=True)
        for r in rows:
            t, after = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
            half = len(t) // 2
            assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
            assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_stages_keep_columns_and_take_effect(request, spark, name):
    docs = request.getfixturevalue(name)
    for stage, f in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.stash(f(spark, docs, SF))
        if stage != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if stage in ("quality", "near_dedup"):
            assert docs.count() <= before
        if stage == "near_dedup":
            assert docs.count() == docs.select("doc_id", "text").distinct().count()
        if stage == "personal_data":
            assert docs.count() == before and not docs.where(F.col("text").rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")).count()
    seqs = defaultdict(int)
    for r in docs.collect():
        seqs[r["sequence_id"]] += r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in seqs.values())
    assert bool(seqs) == (name != "none")


def test_run_is_the_stages(spark):
    df = corpus_pipeline.run(spark, SF)
    assert df.count() > 0 and {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(df.columns)
