"""Evaluation tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _small(df: DataFrame) -> DataFrame:
    """Materialise a small aggregate (at most C x C rows) that two branches
    read, so the expensive plan below it runs once."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def confusion(pred: DataFrame, true_col: str = "y", pred_col: str = "pred", classes: DataFrame | None = None) -> DataFrame:
    """``(true_class, pred_class, n)`` zero-filled over the class union
    (C*C rows, bounded by the class count)."""
    counts = _small(pred.groupBy(F.col(true_col).alias("true_class"), F.col(pred_col).alias("pred_class")).agg(
        F.count(F.lit(1)).alias("n")
    ))
    if classes is None:
        # from the (small) counts, not from ``pred``: the scoring plan runs
        # once and its exchange is reused by both branches
        classes = counts.select(F.col("true_class").alias("c")).union(counts.select(F.col("pred_class").alias("c"))).distinct()
    # C x C zero-fill grid from the class list (one row holding C codes,
    # exploded twice): no join, bounded by the class count
    cs = classes.agg(F.sort_array(F.collect_set(F.col(classes.columns[0]))).alias("cs"))
    grid = cs.select(F.explode("cs").alias("true_class"), "cs").select("true_class", F.explode("cs").alias("pred_class"))
    return grid.join(counts, ["true_class", "pred_class"], "left").select(
        "true_class", "pred_class", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")
    )


def row_normalised_confusion(conf: DataFrame) -> DataFrame:
    """N / row total (0 for empty rows)."""
    w = Window.partitionBy("true_class")
    tot = F.sum("n").over(w)
    return conf.withColumn("share", F.when(tot > 0, F.col("n") / tot).otherwise(F.lit(0.0)))


def per_class_report(pred: DataFrame, true_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """Per class support, tp, fp, fn, precision, recall, f1.
    One aggregation of ``pred`` (to true x predicted counts); the per-class
    sums are taken from that small table."""
    cnt = _small(pred.groupBy(F.col(true_col).alias("t"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n")))
    t = cnt.groupBy(F.col("t").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    p = cnt.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, "cls", "full_outer").select(
        "cls",
        F.coalesce("support", F.lit(0)).cast("long").alias("support"),
        F.coalesce("tp", F.lit(0)).cast("long").alias("tp"),
        F.coalesce("predicted", F.lit(0)).cast("long").alias("predicted"),
    )
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1)


def summary_report(report: DataFrame) -> DataFrame:
    """A11 summary rows: accuracy, macro and weighted averages."""
    tot = F.sum("support")
    return report.agg(
        (F.sum("tp") / tot).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("mean_class_accuracy"),
    )


def binary_metrics(df: DataFrame, true_col: str, pred_col: str, positive=1) -> DataFrame:
    """Accuracy, precision, recall, F1 with 0 on zero denominators."""
    t = F.col(true_col) == F.lit(positive)
    p = F.col(pred_col) == F.lit(positive)
    a = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(t & p, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(~t & p, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(t & ~p, 1).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col(true_col) == F.col(pred_col), 1).otherwise(0)).alias("correct"),
    )
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    a = a.select(
        "n", "tp", "fp", "fn",
        F.when(F.col("n") > 0, F.col("correct") / F.col("n")).otherwise(F.lit(0.0)).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
    )
    return a.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))


def misclassification_breakdown(pred: DataFrame, true_col="y", pred_col="pred") -> DataFrame:
    """Per true class totals and correct, and counts by wrong class."""
    w = Window.partitionBy("true_class")
    g = pred.groupBy(F.col(true_col).alias("true_class"), F.col(pred_col).alias("pred_class")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(
        "true_class", "pred_class", "n",
        F.sum("n").over(w).alias("total"),
        F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)).over(w).alias("correct"),
    ).where(F.col("true_class") != F.col("pred_class"))


def error_examples(pred: DataFrame, k: int = 5, true_col="y", pred_col="pred", order_col="row_id") -> DataFrame:
    """At most k failed rows per true class, lowest ids first."""
    w = Window.partitionBy(true_col).orderBy(order_col)
    return pred.where(F.col(true_col) != F.col(pred_col)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def confidence_pages(pred: DataFrame, per_page_rows: int, per_page_cols: int, top_n: int | None = None,
                     class_col="pred", conf_col="confidence", order_col="row_id") -> DataFrame:
    """Per class rank by confidence (desc, id asc), page/row/col position.
    With ``top_n`` the window is followed by its limit (Spark plans a
    partial per-task limit); without it the rank is computed by
    ``rank_within_group`` so no task sorts a whole class."""
    if top_n is not None:
        w = Window.partitionBy(class_col).orderBy(F.col(conf_col).desc(), F.col(order_col))
        r = pred.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).withColumn("rank", F.col("rank") - 1)
    else:
        from pairbayes.operators.sampling import rank_within_group

        r = rank_within_group(pred, class_col, [F.col(conf_col).desc(), F.col(order_col)], "rank").withColumn("rank", F.col("rank") - 1)
    per_page = per_page_rows * per_page_cols
    return r.withColumn("page", F.floor(F.col("rank") / per_page).cast("int")).withColumn(
        "grid_row", F.floor((F.col("rank") % per_page) / per_page_cols).cast("int")
    ).withColumn("grid_col", (F.col("rank") % per_page_cols).cast("int"))


def confusion_class_weights(conf: DataFrame, n_classes: int) -> DataFrame:
    """weight = 1 - recall per class, scaled to sum to C (empty rows divide by 1)."""
    g = conf.groupBy("true_class").agg(
        F.sum("n").alias("tot"),
        F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)).alias("tp"),
    )
    g = g.withColumn("w", F.lit(1.0) - F.col("tp") / F.when(F.col("tot") == 0, F.lit(1)).otherwise(F.col("tot")))
    tot = F.sum("w").over(Window.partitionBy())
    # every class perfect: all weights 0 -> uniform weight 1 (no 0/0)
    return g.select(F.col("true_class").alias("cls"),
                    F.when(tot > 0, F.col("w") * F.lit(float(n_classes)) / tot).otherwise(F.lit(1.0)).alias("weight"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information (arithmetic-mean normaliser) from
    contingency counts.  H(a) = -sum_ab (n_ab/N) ln(n_a/N), so one aggregate
    over the contingency table gives MI, H(a) and H(b) together."""
    cont = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("nab"))
    cont = cont.select(
        "nab",
        F.sum("nab").over(Window.partitionBy(a)).alias("na"),
        F.sum("nab").over(Window.partitionBy(b)).alias("nb"),
        F.sum("nab").over(Window.partitionBy()).alias("N"),
    )
    q = F.col("nab") / F.col("N")
    r = cont.agg(
        F.sum(q * F.ln(F.col("N") * F.col("nab") / (F.col("na") * F.col("nb")))).alias("mi"),
        (-F.sum(q * F.ln(F.col("na") / F.col("N")))).alias("h_a"),
        (-F.sum(q * F.ln(F.col("nb") / F.col("N")))).alias("h_b"),
    )
    d = (F.col("h_a") + F.col("h_b")) / 2
    return r.withColumn("nmi", F.when(d == 0, F.lit(1.0)).otherwise(F.col("mi") / d))
