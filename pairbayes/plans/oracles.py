"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code: the histogram score is the direct
sum over all pairs and classes of ln(p*w + eps) (a dense rows x classes
table), where the Spark plan uses the sparse correction form.
"""

from __future__ import annotations

from pairbayes.plans.learner_queries import BOOST_BINS, EMB_BINS, EMB_DIMS, ROUND


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


EMB_SRC = "SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label, embedding AS e FROM embeddings"
LI_SRC = ("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS row_id, "
          "l_returnflag AS label, [l_quantity, l_extendedprice, l_discount, l_tax] AS e FROM lineitem")


def boost_base() -> str:
    """Histogram CTEs of the lineitem model used by the boosting queries."""
    return hist_base(LI_SRC, 4, BOOST_BINS)


def emb_base(dims: int = EMB_DIMS, B: int = EMB_BINS) -> str:
    """CTEs: src, cls, ncls, feat, edges, bins, pairs, rowcells, counts."""
    return hist_base(EMB_SRC, dims, B)


def hist_base(src_sql: str, dims: int, B: int, fit_filter: str | None = None) -> str:
    """Histogram CTEs over ``src_sql`` (row_id, label, e array).  With
    ``fit_filter`` (a predicate on row_id) the classes, edges and counts come
    from the rows passing it, while ``rowcells`` covers every row."""
    pad = f"greatest((mx - mn) * {D('0.01')}, {D('1e-6')})"
    fit = f"WHERE {fit_filter}" if fit_filter else ""
    fit_and = f"AND {fit_filter.replace('row_id', 'x.row_id')}" if fit_filter else ""
    return f"""
src AS ({src_sql}),
cls AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS y
        FROM (SELECT DISTINCT label FROM src WHERE label IS NOT NULL {('AND ' + fit_filter) if fit_filter else ''})),
labelled AS (SELECT s.row_id, c.y, s.e FROM src s JOIN cls c ON s.label = c.label),
ncls AS (SELECT y, count(*) AS nc FROM labelled {fit} GROUP BY y),
feat AS (SELECT l.row_id, l.y, CAST(t.f AS INTEGER) AS f, CAST(l.e[t.f + 1] AS DOUBLE) AS v
         FROM labelled l CROSS JOIN range(0, {dims}) t(f)),
mm AS (SELECT f, min(v) AS mn, max(v) AS mx FROM feat x WHERE v IS NOT NULL AND NOT isnan(v) {fit_and} GROUP BY f),
edges AS (SELECT f, mn - {pad} AS lo, mx + {pad} AS hi, ((mx + {pad}) - (mn - {pad})) / {D(B)} AS width FROM mm),
bins AS MATERIALIZED (SELECT x.row_id, x.y, x.f,
           CASE WHEN x.v IS NULL OR isnan(x.v) THEN -1
                ELSE CAST(least(greatest(CAST(ceil((x.v - e.lo) / e.width) AS BIGINT) - 1, 0), {B - 1}) AS INTEGER) END AS b
         FROM feat x JOIN edges e ON x.f = e.f),
pairs AS (SELECT CAST(a.f AS INTEGER) AS f1, CAST(b.f AS INTEGER) AS f2,
                 CAST(row_number() OVER (ORDER BY a.f, b.f) - 1 AS INTEGER) AS pair_id
          FROM range(0, {dims}) a(f) JOIN range(0, {dims}) b(f) ON a.f < b.f),
rowcells AS MATERIALIZED (SELECT x.row_id, x.y, p.pair_id, x.b AS bi, z.b AS bj
             FROM bins x JOIN pairs p ON x.f = p.f1 JOIN bins z ON z.row_id = x.row_id AND z.f = p.f2),
counts AS MATERIALIZED (SELECT y, pair_id, bi, bj, count(*) AS n FROM rowcells x WHERE TRUE {fit_and} GROUP BY y, pair_id, bi, bj)"""


def score_ctes(tag: str, weights: str | None, B: int = EMB_BINS) -> str:
    """CTEs ``ll_{tag}``, ``post_{tag}``, ``pred_{tag}`` scoring every row
    against every class with weights table ``weights`` (or w0)."""
    wjoin = (f"LEFT JOIN {weights} w ON w.y = c.y AND w.pair_id = r.pair_id AND w.bi = r.bi AND w.bj = r.bj"
             if weights else "")
    wexpr = "coalesce(w.w, 1e-6)" if weights else "1e-6"
    p = f"(({D('coalesce(k.n, 0)')} + 1.0e0) / ({D('c.nc')} + {D(B * B)} + 1e-8))"
    return f"""
ll_{tag} AS MATERIALIZED (SELECT r.row_id, r.y AS ytrue, c.y AS cls, sum(ln({p} * {wexpr} + 1e-10)) AS ll
        FROM rowcells r CROSS JOIN ncls c
        LEFT JOIN counts k ON k.y = c.y AND k.pair_id = r.pair_id AND k.bi = r.bi AND k.bj = r.bj
        {wjoin}
        GROUP BY r.row_id, r.y, c.y),
ex_{tag} AS (SELECT row_id, ytrue, cls, exp(ll - max(ll) OVER (PARTITION BY row_id)) AS e FROM ll_{tag}),
post_{tag} AS MATERIALIZED (SELECT row_id, ytrue, cls, e / (sum(e) OVER (PARTITION BY row_id) + 1e-10) AS p FROM ex_{tag}),
rk_{tag} AS (SELECT row_id, ytrue, cls, p, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, cls) AS rn FROM post_{tag}),
pred_{tag} AS MATERIALIZED (SELECT a.row_id, a.ytrue, a.cls AS pred, a.p AS pmax, t.p AS ptrue
        FROM rk_{tag} a JOIN post_{tag} t ON t.row_id = a.row_id AND t.cls = a.ytrue WHERE a.rn = 1)"""


def boost_ctes(tag: str, prev_w: str | None, pred: str, lr_expr: str, B: int = EMB_BINS) -> str:
    """Weights ``w_{tag}`` after one update from failures in ``pred``."""
    p = f"(({D('coalesce(k.n, 0)')} + 1.0e0) / ({D('c.nc')} + {D(B * B)} + 1e-8))"
    upd = f"""
fail_{tag} AS (SELECT row_id, ytrue AS y, pred, ({lr_expr}) * (1.0e0 - ptrue / pmax) AS adj FROM {pred} WHERE pred <> ytrue),
upd_{tag} AS (SELECT f.y, r.pair_id, r.bi, r.bj, sum(f.adj) AS dw
        FROM fail_{tag} f JOIN rowcells r ON r.row_id = f.row_id
        JOIN ncls c ON c.y = f.pred
        LEFT JOIN counts k ON k.y = f.pred AND k.pair_id = r.pair_id AND k.bi = r.bi AND k.bj = r.bj
        WHERE {p} < 0.25e0
        GROUP BY f.y, r.pair_id, r.bi, r.bj)"""
    if prev_w is None:
        return upd + f""",
w_{tag} AS MATERIALIZED (SELECT y, pair_id, bi, bj, 1e-6 + dw AS w FROM upd_{tag})"""
    return upd + f""",
w_{tag} AS MATERIALIZED (SELECT coalesce(a.y, b.y) AS y, coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.bi, b.bi) AS bi,
        coalesce(a.bj, b.bj) AS bj, coalesce(a.w, 1e-6) + coalesce(b.dw, 0.0e0) AS w
        FROM {prev_w} a FULL OUTER JOIN upd_{tag} b ON a.y = b.y AND a.pair_id = b.pair_id AND a.bi = b.bi AND a.bj = b.bj)"""


def two_epoch_ctes() -> str:
    """Score W0 -> update (lr 0.05) -> score W1 -> update (lr by the
    improvement rule) -> W2."""
    B = BOOST_BINS
    s = boost_base() + "," + score_ctes("e0", None, B) + "," + boost_ctes("e0", None, "pred_e0", "0.05e0", B)
    s += "," + score_ctes("e1", "w_e0", B)
    s += """,
err AS (SELECT (SELECT count(*) FROM pred_e0 WHERE pred <> ytrue) AS n0,
               (SELECT count(*) FROM pred_e1 WHERE pred <> ytrue) AS n1,
               (SELECT count(*) FROM pred_e0) AS n)"""
    lr2 = ("(SELECT CASE WHEN n1 * 1.0e0 / n <= n0 * 1.0e0 / n AND (n0 * 1.0e0 / n - n1 * 1.0e0 / n) > 0.001e0 "
           "THEN 0.05e0 ELSE 0.025e0 END FROM err)")
    s += "," + boost_ctes("e1", "w_e0", "pred_e1", lr2, B)
    return s


def learner_oracles() -> dict[str, str]:
    base = "WITH " + emb_base()
    r = ROUND
    out = {
        "emb_bin_edges": base + f"""
SELECT CAST(f AS INTEGER) AS feature, round(lo, 9) AS lo, round(width, 9) AS width, round(lo + width * {D(EMB_BINS)}, 9) AS hi FROM edges""",
        "emb_bin_assign": base + """
SELECT row_id, f AS feature, b AS bin FROM bins""",
        "emb_cell_counts": base + """
SELECT k.y, k.pair_id, p.f1, p.f2, k.bi, k.bj, k.n FROM counts k JOIN pairs p ON p.pair_id = k.pair_id""",
        "emb_likelihood": base + f"""
SELECT k.y, k.pair_id, k.bi, k.bj, round(({D('k.n')} + 1.0e0) / ({D('c.nc')} + {D(EMB_BINS * EMB_BINS)} + 1e-8), 9) AS p
FROM counts k JOIN ncls c ON c.y = k.y""",
        "emb_overlap_cells": base + """
SELECT pair_id, bi, bj, count(DISTINCT y) AS n_classes FROM counts GROUP BY pair_id, bi, bj HAVING count(DISTINCT y) >= 2""",
        "emb_posterior": base + "," + score_ctes("s", None) + f"""
SELECT row_id, ytrue AS true_class, pred AS pred_class, round(pmax, {r}) AS confidence FROM pred_s""",
        "emb_confusion": base + "," + score_ctes("s", None) + """,
cl AS (SELECT DISTINCT ytrue AS c FROM pred_s UNION SELECT DISTINCT pred FROM pred_s),
cnt AS (SELECT ytrue, pred, count(*) AS n FROM pred_s GROUP BY ytrue, pred)
SELECT a.c AS true_class, b.c AS pred_class, coalesce(cnt.n, 0) AS n
FROM cl a CROSS JOIN cl b LEFT JOIN cnt ON cnt.ytrue = a.c AND cnt.pred = b.c""",
        "li_boost_weights": "WITH " + two_epoch_ctes() + """
SELECT y, pair_id, bi, bj, round(w, 9) AS w FROM w_e1""",
        "li_boosted_predictions": "WITH " + two_epoch_ctes() + "," + score_ctes("e2", "w_e1", BOOST_BINS) + f"""
SELECT row_id, ytrue AS true_class, pred AS pred_class, round(pmax, {r}) AS confidence FROM pred_e2""",
        "emb_class_report": base + "," + score_ctes("s", None) + f""",
t AS (SELECT ytrue AS cls, count(*) AS support, sum(CASE WHEN pred = ytrue THEN 1 ELSE 0 END) AS tp FROM pred_s GROUP BY ytrue),
q AS (SELECT pred AS cls, count(*) AS predicted FROM pred_s GROUP BY pred),
j AS (SELECT coalesce(t.cls, q.cls) AS cls, CAST(coalesce(t.support, 0) AS BIGINT) AS support, CAST(coalesce(t.tp, 0) AS BIGINT) AS tp,
             CAST(coalesce(q.predicted, 0) AS BIGINT) AS predicted FROM t FULL OUTER JOIN q ON t.cls = q.cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp * 1.0e0 / predicted ELSE 0.0e0 END AS precision,
                CASE WHEN support > 0 THEN tp * 1.0e0 / support ELSE 0.0e0 END AS recall FROM j)
SELECT cls, support, tp, predicted, round(precision, {r}) AS precision, round(recall, {r}) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2.0e0 * precision * recall / (precision + recall) ELSE 0.0e0 END, {r}) AS f1 FROM m""",
        "emb_class_moments": base + f""",
pv AS (SELECT a.y, p.pair_id, a.v AS a, b.v AS b FROM feat a JOIN pairs p ON a.f = p.f1 JOIN feat b ON b.row_id = a.row_id AND b.f = p.f2),
g AS (SELECT y, pair_id, count(*) AS n, avg(a) AS m1, avg(b) AS m2, var_samp(a) AS v11, covar_samp(a, b) AS v12, var_samp(b) AS v22 FROM pv GROUP BY y, pair_id)
SELECT y, pair_id, n, round(m1, {r}) AS m1, round(m2, {r}) AS m2,
  round(coalesce(v11 * ((n - 1.0e0) / (n - 1.0e0 + 1e-6)), 0.0e0) + 1e-6, {r}) AS c11,
  round(coalesce(v12 * ((n - 1.0e0) / (n - 1.0e0 + 1e-6)), 0.0e0), {r}) + 0.0e0 AS c12,
  round(coalesce(v22 * ((n - 1.0e0) / (n - 1.0e0 + 1e-6)), 0.0e0) + 1e-6, {r}) AS c22 FROM g""",
    }
    rep_body = out["emb_class_report"].split("\nSELECT cls, support, tp, predicted,")[0]
    out["emb_summary_report"] = rep_body + f""",
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0e0 * precision * recall / (precision + recall) ELSE 0.0e0 END AS f1 FROM m)
SELECT round(sum(tp) * 1.0e0 / sum(support), {r}) AS accuracy,
       round(avg(precision), {r}) AS macro_precision, round(avg(recall), {r}) AS macro_recall, round(avg(f1), {r}) AS macro_f1,
       round(sum(precision * support) / sum(support), {r}) AS weighted_precision,
       round(sum(recall * support) / sum(support), {r}) AS weighted_recall,
       round(sum(f1 * support) / sum(support), {r}) AS weighted_f1,
       round(avg(CASE WHEN support > 0 THEN recall END), {r}) AS mean_class_accuracy FROM rep"""
    out["emb_gaussian_predictions"] = base + f""",
pv AS (SELECT a.row_id, a.y, p.pair_id, a.v AS a, b.v AS b FROM feat a JOIN pairs p ON a.f = p.f1 JOIN feat b ON b.row_id = a.row_id AND b.f = p.f2),
g AS (SELECT y, pair_id, count(*) AS n, avg(a) AS m1, avg(b) AS m2, var_samp(a) AS v11, covar_samp(a, b) AS v12, var_samp(b) AS v22 FROM pv GROUP BY y, pair_id),
mo AS (SELECT y, pair_id, m1, m2,
  coalesce(v11 * ((n - 1.0e0) / (n - 1.0e0 + 1e-6)), 0.0e0) + 1e-6 + 1e-6 AS a11,
  coalesce(v12 * ((n - 1.0e0) / (n - 1.0e0 + 1e-6)), 0.0e0) AS a12,
  coalesce(v22 * ((n - 1.0e0) / (n - 1.0e0 + 1e-6)), 0.0e0) + 1e-6 + 1e-6 AS a22 FROM g),
q AS (SELECT y, pair_id, m1, m2, a22 / (a11 * a22 - a12 * a12) AS q11, -a12 / (a11 * a22 - a12 * a12) AS q12,
             a11 / (a11 * a22 - a12 * a12) AS q22 FROM mo),
ll AS (SELECT r.row_id, r.y AS ytrue, q.y AS cls,
         sum(-0.5e0 * (q.q11 * (r.a - q.m1) * (r.a - q.m1) + 2.0e0 * q.q12 * (r.a - q.m1) * (r.b - q.m2) + q.q22 * (r.b - q.m2) * (r.b - q.m2)) + ln(1e-6 + 1e-10)) AS ll
       FROM pv r JOIN q ON q.pair_id = r.pair_id GROUP BY r.row_id, r.y, q.y),
ex AS (SELECT row_id, ytrue, cls, exp(ll - max(ll) OVER (PARTITION BY row_id)) AS e FROM ll),
po AS (SELECT row_id, ytrue, cls, e / (sum(e) OVER (PARTITION BY row_id) + 1e-10) AS p FROM ex),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, cls) AS rn FROM po)
SELECT row_id, ytrue AS true_class, cls AS pred_class, round(p, {r}) AS confidence FROM rk WHERE rn = 1"""
    return out
