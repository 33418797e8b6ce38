"""Packing, sharding, mixing and sketches against brute force."""

import zlib
from fractions import Fraction
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pairbayes.llm import curve_pack, mixing, shards, sketch

PATH = public_tokenizers.path("word_bpe_49k.json")


def packed_ids(rows, length=2048):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] == len(p["ids"]) // 4 > 0
            at += p["length"]
        assert at == length or at & (at - 1) == 0 and at < length


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_packing_round_trip(request, name):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(name).withColumn("sequence_id", F.lit("clash"))
    rows = curve_pack.pack(df, PATH, ids_per_task=1 << 14).collect()
    packed_ids(rows)
    tok, want, got = Tokenizer.from_file(PATH), defaultdict(int), defaultdict(int)
    for r in df.select("doc_id", "text").collect():
        want[r["doc_id"], np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["id"], r["doc_tokens"]].append(r)
    for (key, n), pieces in by_doc.items():
        raw = b"".join(p["ids"] for p in sorted(pieces, key=lambda p: (p["start"], p["sequence_id"], p["offset"])))
        copies = len(raw) // (4 * n)
        if copies == 1:
            got[key, raw] += 1
        else:  # repeated rows or equal ids: count only
            got[key, None] += copies
    assert sum(want.values()) == sum(got.values())
    assert all(want[k] == v for k, v in got.items() if k[1] is not None)


def test_words_cached_by_parts_equal_whole_texts():
    from tokenizers import Tokenizer

    texts = ["It's we'll THE'RE ÀÉ ﬁ Σας ΣΑΣ x　y ´á 1234 <|endoftext|> !!a?? 😀😀", "", "a\x0bb\x0cc\r\nd"]
    codes = curve_pack.WordCodes(PATH, limit=4)
    ids, n = codes.encode([t.encode() for t in texts], 1)
    whole = [[*e.ids, 1] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == sum(whole, []) and n.tolist() == list(map(len, whole))


def test_hilbert_neighbours_touch():
    side = 16
    points = np.array([(x, y) for x in range(side) for y in range(side)])
    key = curve_pack.hilbert_key(points, 4)
    walk = points[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(side * side))
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_shards_are_whole_and_even(request, name):
    df = request.getfixturevalue(name).withColumn("bucket", F.lit(1)).withColumn("pos", F.lit("x"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    placed = shards.shuffle_shards(df, 5, size, bucket_bytes=20_000)
    rows = placed.collect()
    key = lambda r: repr(tuple(r))
    assert sorted(key(r["record"]) for r in rows) == sorted(map(key, df.collect()))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    n = [len(by[s]) for s in range(5)]
    assert max(n) - min(n) <= 1
    assert sorted((key(r["record"]), r["shard"], r["slot"]) for r in placed.collect()) == sorted((key(r["record"]), r["shard"], r["slot"]) for r in rows)


def test_shards_written(docs, tmp_path):
    size = F.octet_length("text") + 8
    shards.write_shards(shards.shuffle_shards(docs, 4, size), str(tmp_path / "out"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == docs.count()


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_mix_meets_targets(request, name):
    clash = ["pieces", "size", "target", "source_size", "record", "k", "h", "id", "bucket", "lo", "base"]
    df = request.getfixturevalue(name).withColumns({c: F.lit("clash") for c in clash})
    rows = mixing.mix(df, n_shards=4, block=16, n_buckets=3).collect()
    assert len(rows) == df.count() and all(r["record"][c] == "clash" for r in rows for c in clash)
    sizes, taken, got_targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        words = len((r["record"]["text"] or "").encode().split())
        got = sum(p["words"] for p in r["pieces"])
        assert r["size"] == words and got <= 2 * words
        spans = sorted((p["copy"], p["start"], p["start"] + p["words"]) for p in r["pieces"])
        assert all(a[0] < b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
        assert all(0 <= a < b <= words for _, a, b in spans)
        source = r["record"]["source"]
        sizes[source] += words
        taken[source] += got
        got_targets[source] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = targets_by_hand([sizes[s] for s in order])
    for s, t in zip(order, want, strict=True):
        assert got_targets[s] == pytest.approx(float(t)) and t <= 2 * sizes[s]
        assert abs(taken[s] - t) <= 1
    if sum(sizes.values()):
        assert sum(want) == Fraction(3, 2) * sum(sizes.values())
    # what the shards hold is what the tree deals
    blocks = defaultdict(set)
    for r in rows:
        for p in r["pieces"]:
            blocks[p["shard"]].add((r["record"]["source"], p["copy"], p["place"]))
    held = [len(blocks[k]) for k in range(4)]
    assert max(held) - min(held) <= 2 or sum(held) < 8


def targets_by_hand(sizes):
    """Water filling in exact fractions: raise one level until a source is full, then share the rest again."""
    total, full = Fraction(3, 2) * sum(sizes), set()
    weights = [Fraction((5, 2, 1)[i % 3]) for i in range(len(sizes))]
    while True:
        rest = total - sum(2 * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 2 * sizes[i]}
        if not over:
            return [Fraction(2 * sizes[i]) if i in full else share[i] for i in range(len(sizes))]
        full |= over


def test_splitting_tree_is_exact():
    counts = np.array([1000, 3, 0, 517])
    q = mixing.shard_quotas(counts, 6, seed=2)
    assert (q.sum(axis=0) == counts).all() and np.ptp(q.sum(axis=1)) <= 2
    assert (q == mixing.shard_quotas(counts, 6, seed=2)).all()


def test_mixed_rows_hold_the_words(spark, docs, tmp_path):
    mixed = mixing.mix(docs.select("doc_id", "text", "lang", "source", "n_chars"), n_shards=3, block=16)
    want = mixed.agg(F.sum(F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["words"]))).first()[0]
    cut = mixing.mixed_rows(mixed, chars_col="n_chars")
    rows = mixing.in_shard_order(cut).collect()
    assert sum(len(r["record"]["text"].encode().split()) for r in rows) == want
    assert all(r["record"]["n_chars"] == len(r["record"]["text"]) for r in rows)
    assert [(r["shard"], r["place"]) for r in rows] == sorted((r["shard"], r["place"]) for r in rows)
    pieces = {(r["record"]["doc_id"], p["shard"], p["place"]) for r in mixed.collect() for p in r["pieces"]}
    assert {(r["record"]["doc_id"], r["shard"], r["place"]) for r in rows} <= pieces
    mixing.write_shards(cut, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2} and back.count() == len(rows)


def test_texts_are_shuffled_once(spark, docs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(sent) <= 3  # the records, the sums and their places


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_next_row(request, name):
    df = request.getfixturevalue(name).select("doc_id", "text")
    rows = sketch.with_next(df, rows_per_bucket=7).collect()
    assert len(rows) == df.count()
    ids = [r["doc_id"] for r in rows]
    if len(set(ids)) == len(ids):
        order = sorted(rows, key=lambda r: -r["doc_id"])
        for r, after in zip(order, [*order[1:], *order[:1]], strict=True):
            assert r["next_text"] == after["text"]


def test_sketch_against_sets(docs, edge):
    df = docs.select("text").union(edge.select("text")).withColumn("other", F.substring("text", 1, 400))
    both = sketch.sketched(df, {"text": "a", "other": "b"}, fraction=1.0)
    both = both.withColumns({"near": sketch.containment(F.col("a"), F.col("b")), "f": sketch.fingerprint(F.col("a"))})
    prints = defaultdict(set)
    for r in both.collect():
        sets = []
        for t in (r["text"], r["other"]):
            w = (t or "").lower().encode().split()
            sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
        assert len(r["a"]) == len(sets[0]) and len(r["b"]) == len(sets[1])
        least = min(map(len, sets))
        want = len(sets[0] & sets[1]) / least if least else float(not sets[0] and not sets[1])
        assert r["near"] == pytest.approx(want)
        prints[r["text"]].add(r["f"])
    assert all(len(v) == 1 for v in prints.values())


def test_small_fraction_estimates_containment(docs):
    df = docs.withColumn("other", F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    got = sketch.sketched(df.where("n_chars > 5000"), {"text": "a", "other": "b"}).select(sketch.containment(F.col("a"), F.col("b"))).collect()
    assert np.mean([r[0] for r in got]) > 0.95
    assert zlib.crc32(b"") == 0
