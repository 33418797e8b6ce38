"""Registered name-matching queries (J5, J6) over ``pages`` and their oracles.

Targets are called after host and language, files after language, host and page number, so that
equal names do not exist; the hybrid query writes coordinates into most names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbayes.operators.names import candidates, fuzzy_match, hybrid_match, stem
from pairbayes.session import table

R = 6
# host without its ending, language, number of a page's address
PARTS = r"^https?://([^/]+?)\.example\.[a-z]+/([a-z]+)/(\d*)"


def _parts(spark, sf) -> DataFrame:
    """page_id, host, lang, num, and two coordinates that follow the number and the page's length."""
    p = table(spark, sf, "pages")
    host, lang, num = (F.regexp_extract("url", PARTS, i) for i in (1, 2, 3))
    return p.select("page_id", F.translate(host, ".", "_").alias("host"), lang.alias("lang"), num.alias("num"),
                    (F.col("page_id") % 360).cast("string").alias("x"), (F.length("html") % 90).cast("string").alias("y"))


def _targets(p: DataFrame) -> DataFrame:
    return p.select(F.concat_ws("_", "host", "lang").alias("target")).distinct()


def _files(p: DataFrame) -> DataFrame:
    return p.select(F.concat(F.concat_ws("_", "lang", "host", "num"), F.lit(".jpg")).alias("file"))


def page_name_candidates(spark, sf) -> DataFrame:
    """J5's blocking: for each target the files that share enough characters for a similarity of 0.6."""
    p = _parts(spark, sf)
    a = _targets(p).select(F.lower(stem(F.col("target"))).alias("stem")).distinct()
    b = _files(p).select(F.lower(stem(F.col("file"))).alias("stem")).distinct()
    return candidates(a, b).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("shared").cast("long").alias("most"), F.sum("shared").alias("total"))


def page_fuzzy_match(spark, sf) -> DataFrame:
    """The most similar file of every target, at similarity 0.6 or more."""
    p = _parts(spark, sf)
    m = fuzzy_match(_targets(p), _files(p))
    return m.select("target", "match", F.round("similarity", R).alias("similarity"))


def page_hybrid_match(spark, sf) -> DataFrame:
    """Coordinates in the names decide where they are near, else the names."""
    p = _parts(spark, sf)
    place = F.concat(F.lit("_"), F.col("x"), F.lit(".25_"), F.col("y"), F.lit(".5"))
    # two pages in three carry coordinates in the target, files of hosts with a dot-free name carry them shifted
    target = F.concat(F.concat_ws("_", "lang", "host"), F.when(F.length("num") != 2, place).otherwise(F.lit("")), F.lit(".png"))
    moved = F.concat(F.lit("_"), F.col("x"), F.lit(".75_"), (F.col("y").cast("int") + F.length("host") % 3).cast("string"), F.lit(".5"))
    file = F.concat(F.concat_ws("_", "host", "lang"), F.when(~F.contains("host", F.lit("_")), moved).otherwise(F.lit("")), F.lit(".jpg"))
    m = hybrid_match(p.select(target.alias("target")), p.select(file.alias("file")))
    return m.select("target", "match", F.round("score", R).alias("score"), "method")


QUERIES = {"page_name_candidates": page_name_candidates, "page_fuzzy_match": page_fuzzy_match, "page_hybrid_match": page_hybrid_match}


_PARTS_SQL = rf"""parts AS (SELECT page_id, replace(regexp_extract(url, '{PARTS}', 1), '.', '_') AS host,
  regexp_extract(url, '{PARTS}', 2) AS lang, regexp_extract(url, '{PARTS}', 3) AS num,
  CAST(page_id % 360 AS VARCHAR) AS x, CAST(length(html) % 90 AS VARCHAR) AS y FROM pages)"""
_STEM = r"regexp_replace({x}, '^(.+)\.[^.]+$', '\1')"


def _stem(x: str, times: int = 1) -> str:
    for _ in range(times):
        x = _STEM.format(x=x)
    return x


def _shared_sql(targets: str, files: str, stems: int) -> str:
    """CTEs: tgt (target, a), fil (b, name), pairs (a, b, shared) that may reach 0.6."""
    return f"""{_PARTS_SQL}, tgt AS (SELECT DISTINCT target, lower({_stem('target', stems)}) AS a FROM ({targets})),
fil AS (SELECT lower({_stem('file')}) AS b, min(file) AS name FROM ({files}) GROUP BY 1),
ac AS (SELECT a, unnest(string_split(a, '')) AS c FROM (SELECT DISTINCT a FROM tgt)), an AS (SELECT a, c, count(*) AS n FROM ac WHERE c <> '' GROUP BY a, c),
bc AS (SELECT b, unnest(string_split(b, '')) AS c FROM fil), bn AS (SELECT b, c, count(*) AS n FROM bc WHERE c <> '' GROUP BY b, c),
pairs AS MATERIALIZED (SELECT a, b, CAST(sum(least(an.n, bn.n)) AS BIGINT) AS shared FROM an JOIN bn USING (c) GROUP BY a, b
          HAVING sum(least(an.n, bn.n)) >= ceil(0.3e0 * (length(a) + length(b)) - 1e-9))"""


def _fuzzy_sql(targets: str, files: str) -> str:
    """CTEs down to best (target, match, similarity): longest common blocks by a recursion over open stretches."""
    return f"""{_shared_sql(targets, files, 3)},
ai AS (SELECT DISTINCT a, unnest(range(1, length(a) + 1)) AS i FROM pairs), bi AS (SELECT DISTINCT b, unnest(range(1, length(b) + 1)) AS j FROM pairs),
eq AS MATERIALIZED (SELECT p.a, p.b, i, j FROM pairs p JOIN ai ON ai.a = p.a JOIN bi ON bi.b = p.b WHERE substr(p.a, i, 1) = substr(p.b, j, 1)),
work(a, b, a0, a1, b0, b1, k) AS (
  SELECT a, b, CAST(1 AS BIGINT), CAST(length(a) AS BIGINT), CAST(1 AS BIGINT), CAST(length(b) AS BIGINT), CAST(0 AS BIGINT) FROM pairs
  UNION ALL
  SELECT a, b, CASE WHEN s = 0 THEN a0 ELSE x.i + x.n END, CASE WHEN s = 0 THEN x.i - 1 ELSE a1 END,
         CASE WHEN s = 0 THEN b0 ELSE x.j + x.n END, CASE WHEN s = 0 THEN x.j - 1 ELSE b1 END, CASE WHEN s = 0 THEN x.n ELSE 0 END
  FROM (SELECT a, b, a0, a1, b0, b1, i, j, n, row_number() OVER (PARTITION BY a, b, a0, b0, a1, b1 ORDER BY n DESC, i, j) AS place
        FROM (SELECT a, b, a0, a1, b0, b1, min(i) AS i, min(j) AS j, count(*) AS n
              FROM (SELECT w.a, w.b, a0, a1, b0, b1, i, j, i - row_number() OVER (PARTITION BY w.a, w.b, a0, a1, b0, b1, i - j ORDER BY i) AS island
                    FROM work w JOIN eq ON eq.a = w.a AND eq.b = w.b AND i BETWEEN a0 AND a1 AND j BETWEEN b0 AND b1)
              GROUP BY a, b, a0, a1, b0, b1, i - j, island)) x, (VALUES (0), (1)) side(s)
  WHERE x.place = 1),
blocks AS (SELECT a, b, sum(k) AS m FROM work GROUP BY a, b),
sim AS (SELECT a, b, 2.0e0 * m / (length(a) + length(b)) AS s FROM blocks),
inside AS (SELECT DISTINCT a, b FROM tgt, fil WHERE contains(a, b) OR contains(b, a)),
scored AS (SELECT a, b, max(s) AS s FROM (SELECT a, b, s FROM sim UNION ALL SELECT a, b, 0.8e0 FROM inside) GROUP BY a, b),
best AS (SELECT a, name, s FROM scored JOIN fil USING (b) WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, name) = 1),
fuzzy AS (SELECT target, name AS match, s AS similarity FROM tgt LEFT JOIN best USING (a))"""


def oracles() -> dict[str, str]:
    t = "SELECT host || '_' || lang AS target FROM parts"
    f = "SELECT lang || '_' || host || '_' || num || '.jpg' AS file FROM parts"
    ht = "SELECT lang || '_' || host || CASE WHEN length(num) <> 2 THEN '_' || x || '.25_' || y || '.5' ELSE '' END || '.png' AS target FROM parts"
    hf = "SELECT host || '_' || lang || CASE WHEN NOT contains(host, '_') THEN '_' || x || '.75_' || CAST(CAST(y AS INTEGER) + length(host) % 3 AS VARCHAR) || '.5' ELSE '' END || '.jpg' AS file FROM parts"
    place = r"'(-?\d+\.\d+)[_-](-?\d+\.\d+)'"
    xy = lambda c: f"CAST(nullif(regexp_extract({c}, {place}, 1), '') AS DOUBLE) AS px, CAST(nullif(regexp_extract({c}, {place}, 2), '') AS DOUBLE) AS py"
    return {
        "page_name_candidates": f"WITH {_shared_sql(t, f, 1)} SELECT a, count(*) AS n, max(shared) AS most, CAST(sum(shared) AS BIGINT) AS total FROM pairs GROUP BY a",
        "page_fuzzy_match": f"WITH RECURSIVE {_fuzzy_sql(t, f)} SELECT target, match, round(similarity, {R}) AS similarity FROM fuzzy",
        "page_hybrid_match": f"""WITH RECURSIVE {_fuzzy_sql(ht, hf)},
tp AS (SELECT target, {xy('target')} FROM tgt), fp AS (SELECT DISTINCT file, {xy('file')} FROM ({hf})),
near AS (SELECT target, file, sqrt((tp.px - fp.px) * (tp.px - fp.px) + (tp.py - fp.py) * (tp.py - fp.py)) AS d FROM tp, fp
         WHERE tp.px IS NOT NULL AND fp.px IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY d, file) = 1),
m AS (SELECT z.target, z.match, z.similarity, n.file, n.d, CASE WHEN n.d < 1.0 THEN 'coordinates' WHEN z.match IS NOT NULL THEN 'fuzzy'
             WHEN n.file IS NOT NULL THEN 'coordinates' ELSE 'none' END AS method FROM fuzzy z LEFT JOIN near n USING (target))
SELECT target, CASE WHEN method = 'coordinates' THEN file ELSE match END AS match,
       round(CASE WHEN method = 'coordinates' THEN d ELSE similarity END, {R}) AS score, method FROM m""",
    }
