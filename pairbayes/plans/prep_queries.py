"""Registered preparation/profile queries (P*, W*, A1-A3, A20-A21) and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.functions.columns import MISSING_SENTINEL
from pairbayes.operators import encode, prep, sampling
from pairbayes.session import table
from pairbayes.operators.sampling import split_unit_sql

R = 6
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CARD = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def li_class_distribution(spark, sf) -> DataFrame:
    d = prep.class_distribution(table(spark, sf, "lineitem"), "l_returnflag")
    return d.select("class", "n", F.round("pct", R).alias("pct"))


def li_inverse_freq_weights(spark, sf) -> DataFrame:
    d = prep.inverse_frequency_weights(table(spark, sf, "lineitem"), "l_returnflag")
    return d.select("class", "n", F.round("weight", R).alias("weight"))


def li_cardinality_drop(spark, sf) -> DataFrame:
    r = prep.high_cardinality_report(table(spark, sf, "lineitem"), LI_CARD)
    return r.select("column_name", "n_distinct", F.round("ratio", R).alias("ratio"), "kept")


def li_adaptive_cardinality(spark, sf) -> DataFrame:
    r = prep.adaptive_cardinality_report(table(spark, sf, "lineitem"), LI_CARD)
    return r.select("column_name", "n_distinct", F.round("ratio", R).alias("ratio"),
                    F.round("threshold", R).alias("threshold"), "kept")


def li_categorical_columns(spark, sf) -> DataFrame:
    r = prep.categorical_columns(table(spark, sf, "lineitem"), LI_CARD)
    return r.select("column_name", "n_distinct", "categorical")


def li_zscore_stats(spark, sf) -> DataFrame:
    s = prep.column_stats(table(spark, sf, "lineitem"), LI_NUM)
    return s.select("column_name", F.round("mean", R).alias("mean"), F.round("std", R).alias("std"))


def li_zscore_rows(spark, sf) -> DataFrame:
    """P3 then P7: round to 4 decimals (half-even), z-score with sample std."""
    li = table(spark, sf, "lineitem").select(*LI_KEY, *LI_NUM)
    li = prep.round_features(li, LI_NUM, 4)
    z = prep.zscore(li, LI_NUM)
    return z.select(*LI_KEY, *[F.round(c, R).alias(c) for c in LI_NUM])


def li_pop_stats(spark, sf) -> DataFrame:
    s = prep.column_stats(table(spark, sf, "lineitem"), LI_NUM, sample_std=False)
    return s.select("column_name", F.round("mean", R).alias("mean"), F.round("std", R).alias("std"))


def li_minmax_scaled(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select(*LI_KEY, *LI_NUM)
    z = prep.minmax_scale(li, LI_NUM)
    return z.select(*LI_KEY, *[F.round(c, R).alias(c) for c in LI_NUM])


def li_percentiles(spark, sf) -> DataFrame:
    p = prep.percentiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.01, 0.05, 0.5, 0.95, 0.99],
                         by=["l_returnflag"])
    return p.select(F.col("l_returnflag"), *[F.round(c, R).alias(c) for c in p.columns if c != "l_returnflag"])


def doc_null_sentinel(spark, sf) -> DataFrame:
    """Documents left join labels; missing labels -> -99999 + mask."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    s = prep.null_sentinel(d, ["quality", "toxic"])
    return s.select("doc_id", "n_chars", "quality", "toxic", "quality_missing", "toxic_missing")


def part_first_codes(spark, sf) -> DataFrame:
    """First-appearance codes (by p_partkey) of brand, type and size."""
    p = table(spark, sf, "part")
    return encode.first_appearance_codes(p, ["p_brand", "p_type", "p_size"], "p_partkey")


def part_label_codes(spark, sf) -> DataFrame:
    """Sorted label codes of p_type."""
    return encode.label_codes(table(spark, sf, "part"), "p_type")


def orders_encoded(spark, sf) -> DataFrame:
    """Codes learned on orders before 1995 applied to all orders;
    values unseen in training take the mean code."""
    o = table(spark, sf, "orders")
    trainer = o.where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    codes = encode.first_appearance_codes(trainer, ["o_orderpriority", "o_orderstatus"], "o_orderkey")
    enc = encode.apply_codes(o.select("o_orderkey", "o_orderpriority", "o_orderstatus"), codes,
                             ["o_orderpriority", "o_orderstatus"])
    return enc.select("o_orderkey", F.round("o_orderpriority", R).alias("o_orderpriority"),
                      F.round("o_orderstatus", R).alias("o_orderstatus"))


def emb_seed_rows(spark, sf) -> DataFrame:
    """First two rows per class."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"))
    return sampling.seed_rows(e, 2)


def events_split(spark, sf) -> DataFrame:
    """Seeded 80/20 split of events by id; reported as counts per
    split and event type."""
    e = sampling.train_test_split(table(spark, sf, "events"), "event_id", 0.2, 42)
    return e.groupBy("split", "event_type").agg(F.count(F.lit(1)).alias("n"))


def li_cap_per_class(spark, sf) -> DataFrame:
    """W6 on embeddings: first max(2, floor(0.99 n)) rows per class."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"))
    c = sampling.cap_per_class(e)
    return c.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.max("row_id").alias("last_id"))


QUERIES = {
    "li_class_distribution": li_class_distribution,
    "li_inverse_freq_weights": li_inverse_freq_weights,
    "li_cardinality_drop": li_cardinality_drop,
    "li_adaptive_cardinality": li_adaptive_cardinality,
    "li_categorical_columns": li_categorical_columns,
    "li_zscore_stats": li_zscore_stats,
    "li_zscore_rows": li_zscore_rows,
    "li_pop_stats": li_pop_stats,
    "li_minmax_scaled": li_minmax_scaled,
    "li_percentiles": li_percentiles,
    "doc_null_sentinel": doc_null_sentinel,
    "part_first_codes": part_first_codes,
    "part_label_codes": part_label_codes,
    "orders_encoded": orders_encoded,
    "emb_seed_rows": emb_seed_rows,
    "events_split": events_split,
    "emb_cap_per_class": li_cap_per_class,
}


def _card_sql(extra: str = "") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, count(*) AS n_rows FROM lineitem"
        for c in LI_CARD
    )
    return f"card AS ({parts}), cr AS (SELECT column_name, n_distinct, n_rows, n_distinct * 1.0e0 / n_rows AS ratio FROM card)"


def _stats_sql(fn: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), {R}) AS mean, round(CASE WHEN {fn}({c}) IS NULL OR {fn}({c}) = 0 THEN 1.0e0 ELSE {fn}({c}) END, {R}) AS std FROM lineitem"
        for c in LI_NUM
    )


def _codes_sql(src: str, cols, order: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, min({order}) AS first_pos FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in cols
    )
    return f"""(SELECT column_name, value, CAST(row_number() OVER (PARTITION BY column_name ORDER BY first_pos, value) - 1 AS INTEGER) AS code FROM ({parts}))"""


def oracles() -> dict[str, str]:
    key = ", ".join(LI_KEY)
    o = {
        "li_class_distribution": f"""SELECT l_returnflag AS class, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), {R}) AS pct FROM lineitem GROUP BY l_returnflag""",
        "li_inverse_freq_weights": f"""WITH g AS (SELECT l_returnflag AS class, count(*) AS n, 1.0e0 / (count(*) + 1e-8) AS raw FROM lineitem GROUP BY l_returnflag)
SELECT class, n, round(raw / sum(raw) OVER () * count(*) OVER (), {R}) AS weight FROM g""",
        "li_cardinality_drop": f"""WITH {_card_sql()}
SELECT column_name, n_distinct, round(ratio, {R}) AS ratio,
       (ratio <= 0.9e0) OR (max(CASE WHEN ratio <= 0.9e0 THEN 1 ELSE 0 END) OVER () = 0) AS kept FROM cr""",
        "li_adaptive_cardinality": f"""WITH {_card_sql()},
t AS (SELECT *, least(0.9e0, greatest(2.0e0 * quantile_cont(ratio, 0.5) OVER (), 0.1e0)) AS threshold,
             row_number() OVER (ORDER BY ratio, column_name) AS rk FROM cr)
SELECT column_name, n_distinct, round(ratio, {R}) AS ratio, round(threshold, {R}) AS threshold,
       (ratio <= threshold) OR (rk <= {max(2, int(0.2 * len(LI_CARD)))}) AS kept FROM t""",
        "li_categorical_columns": f"""WITH {_card_sql()}
SELECT column_name, n_distinct,
  (column_name IN ('l_returnflag', 'l_linestatus')) OR (n_distinct < least(50.0e0, n_rows * 0.05e0)) AS categorical FROM cr""",
        "li_zscore_stats": _stats_sql("stddev_samp"),
        "li_pop_stats": _stats_sql("stddev_pop"),
        "li_zscore_rows": f"""WITH r AS (SELECT {key}, {", ".join(f"round_even({c}, 4) AS {c}" for c in LI_NUM)} FROM lineitem),
s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) IS NULL OR stddev_samp({c}) = 0 THEN 1.0e0 ELSE stddev_samp({c}) END AS s_{c}" for c in LI_NUM)} FROM r)
SELECT {key}, {", ".join(f"round(({c} - m_{c}) / s_{c}, {R}) AS {c}" for c in LI_NUM)} FROM r CROSS JOIN s""",
        "li_minmax_scaled": f"""WITH s AS (SELECT {", ".join(f"min({c}) AS lo_{c}, CASE WHEN max({c}) - min({c}) = 0 THEN 1.0e0 ELSE max({c}) - min({c}) END AS g_{c}" for c in LI_NUM)} FROM lineitem)
SELECT {key}, {", ".join(f"round(({c} - lo_{c}) / g_{c}, {R}) AS {c}" for c in LI_NUM)} FROM lineitem CROSS JOIN s""",
        "li_percentiles": f"""SELECT l_returnflag, {", ".join(f"round(quantile_cont(l_extendedprice, {p}), {R}) AS p{int(round(p * 100))}" for p in [0.01, 0.05, 0.5, 0.95, 0.99])} FROM lineitem GROUP BY l_returnflag""",
        "doc_null_sentinel": f"""SELECT d.doc_id, d.n_chars, coalesce(CAST(l.quality AS DOUBLE), {MISSING_SENTINEL}) AS quality,
  coalesce(CAST(l.toxic AS DOUBLE), {MISSING_SENTINEL}) AS toxic, l.quality IS NULL AS quality_missing, l.toxic IS NULL AS toxic_missing
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
        "part_first_codes": "SELECT * FROM " + _codes_sql("part", ["p_brand", "p_type", "p_size"], "p_partkey"),
        "part_label_codes": """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT CAST(p_type AS VARCHAR) AS label FROM part WHERE p_type IS NOT NULL)""",
        "orders_encoded": f"""WITH codes AS {_codes_sql("(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01')", ["o_orderpriority", "o_orderstatus"], "o_orderkey")},
m AS (SELECT column_name, avg(code) AS mc FROM codes GROUP BY column_name)
SELECT o.o_orderkey,
  round(coalesce(CAST(a.code AS DOUBLE), (SELECT mc FROM m WHERE column_name = 'o_orderpriority')), {R}) AS o_orderpriority,
  round(coalesce(CAST(b.code AS DOUBLE), (SELECT mc FROM m WHERE column_name = 'o_orderstatus')), {R}) AS o_orderstatus
FROM orders o LEFT JOIN codes a ON a.column_name = 'o_orderpriority' AND a.value = o.o_orderpriority
LEFT JOIN codes b ON b.column_name = 'o_orderstatus' AND b.value = o.o_orderstatus""",
        "emb_seed_rows": """SELECT row_id, y FROM (SELECT vec_id AS row_id, label AS y, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 2""",
        "events_split": f"""SELECT CASE WHEN {split_unit_sql('event_id')} < 0.8e0 THEN 'train' ELSE 'test' END AS split,
  event_type, count(*) AS n FROM events GROUP BY 1, 2""",
        "emb_cap_per_class": """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label AS y, count(*) AS n, max(vec_id) AS last_id FROM r WHERE rn <= greatest(2, floor(n * 0.99e0)) GROUP BY label""",
    }
    return o
