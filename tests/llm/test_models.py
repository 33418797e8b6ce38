"""Classifier, language model, personal data, licences, near copies and neighbours."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairbayes.llm import bloom_lm, hyperminhash, license_scan, perm_index, pii_crf, quality
from pairbayes.llm.components import connected_components, stars

FIXTURES = ["docs", "edge", "none"]


# ---------------------------------------------------------------- quality


def test_quality_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    net = quality.fit(docs, labels.where(part != 0), per_class=600)
    rows = quality.classify(docs, net).join(labels, "doc_id").where(part == 0).select("score", "quality").collect()
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert auc > 0.8
    assert abs(s.mean() - y.mean()) < 0.08  # calibrated to the natural share


@pytest.mark.parametrize("name", FIXTURES)
def test_quality_edges(request, spark, name):
    df = request.getfixturevalue(name)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (7, 1, 1), (4, 0, 0), (9, 7, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(df, quality.fit(df, labels)).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    alone = quality.fit(df, labels.where("quality = 1"))
    assert alone.vectors is None and 0.5 < alone.prior < 1
    assert quality.fit(df, labels.limit(0)).prior == 0.5


# ---------------------------------------------------------------- language model


def brute_base(rows):
    tokens = {i: (r[1] or "").encode().lower().split() + [b""] for i, r in enumerate(rows)}
    trains = [i for i, r in enumerate(rows) if r[0] is None or crc32(str(r[0]).encode()) % 7 != 2]
    c = Counter(w for i in trains for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return n, Counter((r[0], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i]), 6)) for i, r in enumerate(rows)), c, tokens, trains


@pytest.mark.parametrize("name", FIXTURES)
@pytest.mark.parametrize("limit", [None, 3000])
def test_language_model(request, name, limit):
    df = request.getfixturevalue(name).select("doc_id", "text")
    train = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))
    small = {"max_broadcast": limit, "part_bytes": 20_000, "block_bytes": 100_000} if limit else {}
    got = bloom_lm.score(df, train, **small).collect()
    rows = df.collect()
    n, want, c, tokens, trains = brute_base(rows)
    assert Counter((r["id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n for r in got)
    pairs = Counter(p for i in trains for p in zip([b"", *tokens[i]], tokens[i], strict=False))
    v = len(c)
    values = bloom_lm.level_values(64)
    exact = Counter()
    for i, r in enumerate(rows):
        total = 0.0
        for a, b in zip([b"", *tokens[i]], tokens[i], strict=False):
            level = int(bloom_lm.levels(np.array([pairs[a, b]]))[0]) if pairs[a, b] else 0
            total += math.log10((min(values[level], c[a]) + 200.0 * (c[b] + 1) / (n + v + 1)) / (c[a] + 200.0))
        exact[r[0]] += total
    mine = Counter()
    for r in got:
        mine[r["id"]] += r["score"]
    # the filter never reads a level too low; a false positive lifts a score, of a text
    # that repeats the pair more often
    for k, total in exact.items():
        assert mine[k] >= total - 1e-6 and mine[k] <= total + 0.12 * abs(total) + 0.5
    assert sum(mine.values()) <= sum(exact.values()) * 0.99 + 0.5


def test_filter_rounds_agree(docs):
    one = {r["id"]: r["score"] for r in bloom_lm.score(docs, F.lit(True), part_bytes=20_000).collect()}
    many = {r["id"]: r["score"] for r in bloom_lm.score(docs, F.lit(True), part_bytes=20_000, max_broadcast=2000).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-6) for k in one)


def test_held_out_score_beats_base(docs):
    rows = bloom_lm.score(docs, F.col("doc_id") % 5 != 0).where("not train").agg(F.sum("base_score"), F.sum("score")).first()
    assert rows[1] > rows[0]


# ---------------------------------------------------------------- personal data


def brute_spans(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii_crf.KINDS.index(s[2])))


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_random(seed):
    rng = np.random.default_rng(seed)
    for _ in range(1500):
        text = "".join(rng.choice(list("0123456789.@+-() ab%é\n"), rng.integers(0, 60), p=[0.045] * 10 + [0.1, 0.08, 0.04, 0.05, 0.03, 0.03, 0.1, 0.05, 0.03, 0.01, 0.02, 0.01]))
        assert pii_crf.base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("name", FIXTURES)
def test_base_stays(request, name):
    df = request.getfixturevalue(name).withColumn("source", F.lit("clash"))
    rows = pii_crf.find(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        base = [tuple(s) for s in r["base"]]
        assert base == brute_spans(r["text"] or "")
        assert set(base) <= {tuple(s) for s in r["found"]}
        if r["text"] is not None and not r["found"]:
            assert r["masked"] == r["text"]
        assert not (r["masked"] and brute_spans(r["masked"]))


def test_field_finds_more_and_spares_the_rest():
    field = pii_crf.fit(pii_crf.labelled_rows())
    more = ["please call (509) 555-6973 now", "write to john (at) example (dot) com today", "paid by 4111.1111.1111.1111 yesterday"]
    kinds = ["phone", "email", "card"]
    for (_, spans), k in zip(pii_crf.all_spans(more, field), kinds, strict=True):
        assert [s[2] for s in spans] == [k]
    clean = ["This work is licensed under version 3. of 2.0. terms", "on 2024-01-31 at 10:30 we sold 1,200 for $15.99", "token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\" a", "page 12 of 340, section 4.2.1", "order 20240131 and 99887766"]
    assert all(not spans for _, spans in pii_crf.all_spans(clean, field))


def test_viterbi_is_best_path():
    field = pii_crf.fit(pii_crf.labelled_rows(), epochs=2)
    words = "call +1 (509) now 1.2.3.4".split()
    score = field.scores(pii_crf.sequence_features(words))
    k = len(pii_crf.LABELS)

    def value(path):
        return field.step[-1][path[0]] + score[0][path[0]] + sum(field.step[a, b] + score[t + 1][b] for t, (a, b) in enumerate(zip(path, path[1:], strict=False)))

    got = field.decode([words, words[:2], ["x"]])
    assert [len(g) for g in got] == [5, 2, 1]
    best = max(value(p) for p in np.ndindex(*[k] * 5))
    assert value(got[0]) == pytest.approx(best)


# ---------------------------------------------------------------- licences


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "nothing here"), ("a/b/LICENSE.md", "filler " * 40 + "\n" + apache),
        ("a/b/c/y.txt", "text\n" + apache.upper() + "\nmore " * 90), ("a/b/c/z.txt", "free words of the work"), ("d/e.txt", "the version is new"), ("top.txt", None),
        (None, apache), ("a/b/x.txt", "nothing here"), ("a/empty", ""), ("d/long.txt", "pad " * 300 + apache + " pad" * 300),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumn("license_id", F.lit(1))
    rows = license_scan.inherit(license_scan.scan(df)).collect()
    got = {(r["path"], r["own_license"], r["license"], r["inherited_from"]) for r in rows}
    assert len(rows) == len(files)
    assert got == {
        ("a/LICENSE", "MIT", "MIT", None), ("a/b/x.txt", None, "Apache-2.0", "a/b/LICENSE.md"), ("a/b/LICENSE.md", "Apache-2.0", "Apache-2.0", None),
        ("a/b/c/y.txt", "Apache-2.0", "Apache-2.0", None), ("a/b/c/z.txt", None, "Apache-2.0", "a/b/LICENSE.md"), ("d/e.txt", None, None, None), ("top.txt", None, None, None),
        (None, "Apache-2.0", "Apache-2.0", None), ("a/empty", None, "MIT", "a/LICENSE"), ("d/long.txt", "Apache-2.0", "Apache-2.0", None),
    }
    assert license_scan.inherit(license_scan.scan(df.limit(0))).count() == 0


def test_licence_scores_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("cast(doc_id as string) path", "text")
    rows, n = df.collect(), df.count()
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    freq = Counter(w for r in rows for w in set(words(r["text"])))
    idf, vectors = license_scan.weights(license_scan.TEMPLATES, freq, n)
    rarest = math.log(n + 1) + 1
    got = {r["path"]: (r["own_license"], r["own_score"]) for r in license_scan.scan(df).collect()}
    for r in rows:
        best = (0.0, None)
        for line in re.split("[\n\r]+", r["text"]):
            w = words(line)
            cuts = [w[i : i + 24] for i in range(0, max(len(w) - 24, 0) + 1, 12)] if len(w) > 48 else [w]
            for p in cuts:
                lw = {t: (1 + math.log(p.count(t))) * idf[t] if t in idf else rarest for t in set(p)}
                norm = math.sqrt(sum(x * x for x in lw.values()))
                for name, v in vectors:
                    s = sum(lw.get(t, 0) * x for t, x in v.items()) / norm if norm else 0
                    if s > best[0] + 1e-12:
                        best = (s, name)
        if best[0] >= license_scan.THRESHOLD:
            assert got[r["path"]] == (best[1], pytest.approx(best[0], abs=1e-5))
        else:
            assert got[r["path"]][0] is None


def test_long_lines_are_scanned_to_their_end(spark):
    sizes = [48, 49, 59, 60, 61, 72, 73, 108, 120, 121]
    lines = spark.createDataFrame([(n, " ".join(f"t{i}" for i in range(n))) for n in sizes], "n int, text string")
    for r in lines.select("n", license_scan.passages(F.col("text")).alias("p")).collect():
        assert {t for p in r["p"] for t in p} == {f"t{i}" for i in range(r["n"])}
        assert all(len(p) == (license_scan.WINDOW if r["n"] > license_scan.LONG else r["n"]) for p in r["p"])
    apache = "Licensed under the Apache License, Version 2.0."
    files = spark.createDataFrame([(str(n), "pad " * n + apache) for n in (52, 60, 100, 112)], "path string, text string")
    assert [r["own_license"] for r in license_scan.scan(files).collect()] == ["Apache-2.0"] * 4


@pytest.mark.parametrize("times", [1, 200])
def test_licence_statements_inside_prose(spark, times):
    said = [
        ("MIT", "Copyright 2020 Jane Doe. Released under the MIT License. All other words differ"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
        ("GPL-3.0", "This work is licensed under the GNU\n# General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
        (None, "Released under the Foo License."), (None, "we met under the mit roof"),
    ]
    rng = np.random.default_rng(3)
    varied = lambda k: " ".join(f"x{i}" for i in rng.integers(0, 10**6, k))
    files = [(f"{i}/{a}/{b}", f"{varied(a)} {text} {varied(b)}") for i, (_, text) in enumerate(said) for a, b in [(0, 18), (1, 2), (9, 9), (18, 0), (70, 70)]]
    files += [(f"other/{i}", varied(20)) for i in range(300)]
    df = spark.createDataFrame(files, "path string, text string").crossJoin(spark.range(times)).drop("id")
    got = license_scan.scan(df).where("path not like 'other%' or own_license is not null").groupBy("path", "own_license").count().collect()
    assert {(r["path"], r["own_license"], r["count"]) for r in got} == {(p, said[int(p[0])][0], times) for p, _ in files[: 5 * len(said)]}


def test_common_licences_are_known(spark):
    said = [(name, f"# SPDX-License-Identifier: {name}\nimport os") for name in license_scan.SPDX] + list(license_scan.TEMPLATES)
    gnu = "you can redistribute it and/or modify it under the terms of the GNU {} as\n# published by the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\nimport os"
    for name, kind, version in [("GPL-2.0", "General Public License", 2), ("GPL-3.0", "General Public License", 3), ("LGPL-2.1", "Lesser General Public License", 2.1), ("LGPL-3.0", "Lesser General Public License", 3), ("AGPL-3.0", "Affero General Public License", 3)]:
        said.append((name, "# This program is free software: " + gnu.format(kind, version)))
    said.append((None, "a plain text without any statement"))
    files = spark.createDataFrame([(str(i), text) for i, (_, text) in enumerate(said)], "path string, text string")
    got = {r["path"]: r["own_license"] for r in license_scan.scan(files).collect()}
    assert [got[str(i)] for i in range(len(said))] == [name for name, _ in said]


# ---------------------------------------------------------------- near copies


def brute_groups(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    distinct = [s for s in dict.fromkeys(sets) if s]
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(distinct):
        for j in range(i):
            both = len(a & distinct[j])
            if 100 * both >= percent * (len(a) + len(distinct[j]) - both):
                parent[root(i)] = root(j)
    at = {s: root(i) for i, s in enumerate(distinct)}
    low: dict = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            low[at[s]] = min(low.get(at[s], i), i)
    return Counter((i, len(s), low.get(at[s]) if s else i) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("name", FIXTURES)
@pytest.mark.parametrize("size,percent,block", [(3, 85, 512), (5, 80, 3)])
def test_near_copies(request, monkeypatch, name, size, percent, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    df = request.getfixturevalue(name).select("doc_id", "text")
    got = hyperminhash.near_duplicates(df, shingle=size, percent=percent).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups([tuple(r) for r in df.collect()], size, percent)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("block", [512, 20])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    base, rows = [f"w{i}" for i in range(80)], []
    for i in range(150):
        words = list(base)
        for _ in range(rng.integers(0, 9)):
            words[rng.integers(len(words))] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows + [(1000 + i, " ".join(base)) for i in range(60)], "doc_id long, text string")
    got = hyperminhash.near_duplicates(df, shingle=3, percent=85).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups([tuple(r) for r in df.collect()], 3, 85)


def test_one_of_a_group_without_ids_is_kept(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join([*words, end]), "en", "a", 1) for end in ("x", "y", "z", "z")] + [(None, "", "en", "a", 0), (7, "other words stand here for once", "en", "a", 1)]
    rows += [(None, "v " + " ".join(words[::-1]), "en", "a", 1), (3, "u " + " ".join(words[::-1]), "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted((r["doc_id"] or 0, bool(r["text"])) for r in kept) == [(0, False), (0, True), (3, True), (7, True)]


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.85, 0.95):
        errors = []
        for n in (30, 400, 5000):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            both = round(share * n)
            a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:both], pool[n : 2 * n - both]])
            true = both / (2 * n - both)
            regs = hyperminhash.registers([a, b])
            errors.append(hyperminhash.estimate(regs[1:], regs[0], np.array([len(b)]), len(a))[0] - true)
        assert np.abs(errors).max() < 0.2


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (hyperminhash.common_counts(sets) == np.array(want)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 200), (210, 211), (211, 212), (212, 210)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = Counter(got.values())
    assert sorted(groups.values()) == [3, 40, 61] and 200 not in got
    assert all(got[r] == r for r in groups)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert stars(np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0]], bool)) == [(1, 0)]


# ---------------------------------------------------------------- neighbours


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    got: dict = {}
    for r in perm_index.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(m[2] == pytest.approx(s[ids == m[1]][0], abs=1e-12) for m in mine)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(mine, mine[1:], strict=False))
        hits += len({m[1] for m in mine} & {int(ids[i]) for i in order})
        total += 20
    assert hits / total >= 0.95


def test_neighbour_edges(spark, monkeypatch):
    monkeypatch.setattr(perm_index, "BLOCK", 8)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 0.0]), (9, [None, 1.0]), (20, [-1.0, 0.5]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (60, None), (21, [1.0, 2.0, 3.0])]
    rows += [(100 + i, [3.0, 0.0]) for i in range(1, 20)] + [(102, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = perm_index.nearest(df, F.col("vec_id") % 20 == 0, k=4).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20}
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0] == [(101, 3.0), (102, 3.0), (102, 3.0), (103, 3.0)]
    assert [r["vec_id"] for r in got if r["query_id"] == 20] == [3, 0, 1, 2]
    assert perm_index.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
