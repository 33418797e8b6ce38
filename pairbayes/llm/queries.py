"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbayes.llm.common import crc_of_id, word_array
from pairbayes.session import table


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text", "lang", "source", "n_chars")))


def remainder(column: str, by: int):
    return F.pmod(crc_of_id(F.col(column)), F.lit(by))


def op1_random_index_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learnt from labels outside the held-out fifth."""
    from pairbayes.llm import quality as Q

    docs = documents(spark, sf_dir, "doc_id", "text")
    net = Q.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return Q.classify(docs, net).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the quantised word-pair model and its base."""
    from pairbayes.llm import bloom_lm as L

    train = F.coalesce(remainder("doc_id", 7) != 2, F.lit(True))
    scored = L.score(documents(spark, sf_dir, "doc_id", "text"), train)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base pattern spans, and all spans with the field's.

    The counts and the digest are those of the base patterns; ``n_spans`` counts all."""
    from pairbayes.llm import pii_crf as P

    found = P.find(documents(spark, sf_dir, "doc_id", "text"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    same = lambda k: lambda x: x == k
    n = [F.size(F.filter(kinds, same(k))).cast("long").alias(f"n_{k}") for k in P.KINDS]
    return found.select("doc_id", *n, F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("found").alias("spans"), F.size("found").alias("n_spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document as a file of the tree source/lang/range/id, own or inherited."""
    from pairbayes.llm import license_scan as L

    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 256), F.concat(F.col("doc_id"), F.lit(".txt")))
    scanned = L.scan(docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")).drop("text")
    return L.inherit(scanned).select("doc_id", "path", "own_license", "own_score", "license_file", "license", "inherited_from")


def op5_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85 or more."""
    from pairbayes.llm.hyperminhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20, by inner product."""
    from pairbayes.llm.perm_index import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and the next document's."""
    from pairbayes.llm import sketch as S

    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = S.with_next(docs, lambda d: S.sketched(d, {"text": "sketch"}), carry=("text", "sketch"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = S.sketched(rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), {"edited": "edited_sketch"})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        S.fingerprint(F.col("sketch")).alias("fingerprint"), S.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        S.containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        S.containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op8_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 24 shards whose row counts differ by one at most."""
    from pairbayes.llm.shards import shuffle_shards

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    placed = shuffle_shards(documents(spark, sf_dir), 24, size)
    text = F.coalesce("record.text", F.lit(""))
    return placed.select(
        "record.doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids along a Hilbert curve."""
    import public_tokenizers

    from pairbayes.llm.curve_pack import pack

    pieces = pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    from pairbayes.llm.mixing import mix

    mixed = mix(documents(spark, sf_dir, "doc_id", "text", "source"), carry=["doc_id", "source"])
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    shards = F.size(F.array_distinct(F.transform("pieces", lambda p: p["shard"])))
    return mixed.select("record.doc_id", "size", "source_size", "target", taken.alias("taken"), "record.source", F.size("pieces").alias("n_pieces"), shards.alias("n_shards"))


def op11_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings: cosine 0.9 or more."""
    from pairbayes.llm.tile_dedup import near_vectors

    found = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def repeating(docs: DataFrame) -> DataFrame:
    """``docs`` with every text whose id hashes to a multiple of ten made periodic from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, n = F.col("w"), F.size("w").cast("long")
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    cycle = F.slice(w, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    edited = F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), (n - a).cast("int")))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    rows = docs.withColumn("w", F.when(chosen, word_array(F.col("text"))))
    return rows.withColumn("text", F.when(chosen & (F.size("w") > 0), F.array_join(edited, " ")).otherwise(F.col("text"))).drop("w")


def op12_baier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, the longest of them, and digests of all runs
    and of the text without their repeats."""
    from pairbayes.llm.runs import find_runs

    found = find_runs(repeating(documents(spark, sf_dir, "doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("brief"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.withColumn("longest", longest)
    start, length, period = -F.col("longest.back"), F.col("longest.length"), -F.col("longest.brief")
    return rows.select(
        "record.doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100."""
    from pairbayes.llm.cover_tree import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(good).select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives(rows, lambda i: i % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_random_index_quality, op2_bloom_language_model, op3_crf_personal_data, op4_license_scan, op5_hyperminhash_dedup, op6_permutation_index, op7_threshold_sketch, op8_two_pass_shuffle, op9_curve_packing, op10_source_mix, op11_int8_tiles, op12_baier_runs, op13_cover_tree_negatives)}
ORACLES: dict[str, str] = {
    "op11_int8_tiles": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
       WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM least c LEFT JOIN n USING (vec_id)""",
    "op13_cover_tree_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
       list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
       WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
t AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM t WHERE rank <= 5""",
}
