"""Model evaluation. Zero denominators give 0. Rows with a null label, prediction or score are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import ratio
from tessera.operators.stats import attach
from tessera.plans.ordered import running


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = (), *, pos_label: object = 1) -> DataFrame:
    """``tp, fp, fn, tn, precision, recall, f1, accuracy, mcc, support`` of one label against the rest."""
    t, p = F.col(y_true) == F.lit(pos_label), F.col(y_pred) == F.lit(pos_label)
    one = df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()).groupBy(*by)
    one = one.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    d = lambda c: c.cast("double")
    mcc = ratio(d(tp) * d(tn) - d(fp) * d(fn), F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn)))
    return one.select(*by, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), mcc.alias("mcc"), (tp + fn).alias("support"))


def f_beta(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = (), *, beta: float = 1.0, pos_label: object = 1) -> DataFrame:
    if beta <= 0:
        raise ValueError("beta must be positive")
    b2 = beta * beta
    p, r = F.col("precision"), F.col("recall")
    return confusion_matrix(df, y_true, y_pred, by, pos_label=pos_label).select(*by, ratio((1 + b2) * p * r, b2 * p + r).alias("f_beta"))


def per_class(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``class, precision, recall, f1, support, tp, fp, fn`` of every label that is true or predicted."""
    counts = df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()).groupBy(*by, F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(*by, "n", F.explode(F.array(F.struct(F.col("t").alias("class"), F.lit(True).alias("true")), F.struct(F.col("p").alias("class"), F.lit(False).alias("true")))).alias("s"), (F.col("t") == F.col("p")).alias("hit"))
    one = sides.groupBy(*by, F.col("s.class").alias("class")).agg(
        F.coalesce(F.sum(F.when(F.col("hit") & F.col("s.true"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & ~F.col("s.true"), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & F.col("s.true"), F.col("n"))), F.lit(0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return one.select(*by, "class", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), (tp + fn).alias("support"), "tp", "fp", "fn")


def classification_report(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = (), *, method: str = "default") -> DataFrame:
    """``macro_precision, macro_recall, macro_f1, micro_precision, micro_recall, micro_f1, accuracy``.

    Macro F1 is the harmonic mean of macro precision and recall, or with ``method="textbook"`` the mean of the classes' F1.
    """
    one = per_class(df, y_true, y_pred, by).groupBy(*by).agg(F.avg("precision").alias("P"), F.avg("recall").alias("R"), F.avg("f1").alias("F"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    macro = F.col("F") if method == "textbook" else ratio(2 * F.col("P") * F.col("R"), F.col("P") + F.col("R"))
    return one.select(*by, F.col("P").alias("macro_precision"), F.col("R").alias("macro_recall"), macro.alias("macro_f1"), p.alias("micro_precision"), r.alias("micro_recall"), ratio(2 * p * r, p + r).alias("micro_f1"), r.alias("accuracy"))


def _score_steps(df: DataFrame, y_true: str, score: str, by: Sequence[str]) -> DataFrame:
    """Distinct scores from the highest, with positives and negatives before each (``tp0, fp0``) and at it (``pos, neg``)."""
    counts = df.where(F.col(y_true).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) != 1).alias("neg"))
    steps = running(counts, [F.col("s").desc()], {"tp1": F.col("pos"), "fp1": F.col("neg")}, by)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.max("s").alias("top"))
    both = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("P")).otherwise(F.raise_error(F.lit("both classes must occur")).cast("long"))
    return attach(steps, totals.withColumn("P", both), by)


def roc_curve(df: DataFrame, y_true: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``threshold, fpr, tpr`` from (0, 0) to (1, 1): a point before each distinct score is counted, the first at infinity, and a last one at 0."""
    s = _score_steps(df, y_true, score, by)
    tpr, fpr = ratio(F.col("tp1") - F.col("pos"), F.col("P")), ratio(F.col("fp1") - F.col("neg"), F.col("N"))
    points = s.select(*by, F.col("s").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    first = s.where(F.col("s") == F.col("top")).select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    last = s.where(F.col("s") == F.col("top")).select(*by, F.lit(0.0).alias("threshold"), F.when(F.col("N") > 0, 1.0).otherwise(0.0).alias("fpr"), F.when(F.col("P") > 0, 1.0).otherwise(0.0).alias("tpr"))
    return points.unionByName(first).unionByName(last)


def roc_auc(df: DataFrame, y_true: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by trapezoids: each step adds its negatives times the positives above it and half of those at it."""
    s = _score_steps(df, y_true, score, by)
    area = F.sum(F.col("neg") * (F.col("tp1") - F.col("pos") / 2.0))
    return s.groupBy(*by).agg(ratio(area, F.any_value("P").cast("double") * F.any_value("N")).alias("auc"))


def pr_curve(df: DataFrame, y_true: str, score: str, by: Sequence[str] = (), *, id_col: str) -> DataFrame:
    """``rank, threshold, precision, recall``: a point per row from the highest score; within a tie positives come first."""
    rows = df.where(F.col(y_true).isNotNull() & F.col(score).isNotNull()).select(*by, F.col(id_col).alias("id"), F.col(score).cast("double").alias("s"), (F.col(y_true) == 1).cast("long").alias("y"))
    ranked = running(rows, [F.col("s").desc(), F.col("y").desc(), F.col("id")], {"tp": F.col("y"), "rank": F.lit(1).cast("long")}, by)
    total = rows.groupBy(*by).agg(F.sum("y").alias("P"))
    return attach(ranked, total, by).select(*by, "rank", F.col("s").alias("threshold"), ratio(F.col("tp"), F.col("rank")).alias("precision"), ratio(F.col("tp"), F.col("P")).alias("recall"), "y", "P")


def average_precision_score(df: DataFrame, y_true: str, score: str, by: Sequence[str] = (), *, id_col: str) -> DataFrame:
    """Sum of precision times the step in recall."""
    c = pr_curve(df, y_true, score, by, id_col=id_col)
    return c.groupBy(*by).agg(F.coalesce(ratio(F.sum(F.when(F.col("y") == 1, F.col("precision")).otherwise(0.0)), F.any_value("P")), F.lit(0.0)).alias("average_precision"))


def expected_calibration_error(df: DataFrame, y_true: str, prob: str, by: Sequence[str] = (), *, n_bins: int = 10) -> DataFrame:
    """Weighted gap of confidence and accuracy over ``n_bins`` equal bins; a negative probability counts from the last bin back."""
    if n_bins < 1:
        raise ValueError("n_bins must be positive")
    p = F.col(prob).cast("double")
    raw = F.least((p * n_bins).cast("int"), F.lit(n_bins - 1))
    rows = df.where(F.col(y_true).isNotNull() & p.isNotNull()).select(*by, F.when(raw < 0, raw + n_bins).otherwise(raw).alias("bin"), p.alias("p"), (F.col(y_true) == 1).cast("double").alias("y"))
    bins = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("c"), F.avg("y").alias("a"))
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def regression_metrics(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``mae, mse, rmse, r2`` (0 without spread), ``mape`` in per cent (null if any true value is 0)."""
    t, p = F.col("t"), F.col("p")
    rows = df.select(*by, F.col(y_true).cast("double").alias("t"), F.col(y_pred).cast("double").alias("p")).where("t is not null and p is not null")
    one = rows.groupBy(*by).agg(
        F.avg(F.abs(t - p)).alias("mae"), F.avg((t - p) * (t - p)).alias("mse"), F.var_pop("t").alias("spread"),
        F.when(F.max((t == 0).cast("int")) == 0, F.avg(F.try_divide(F.abs(t - p), F.abs(t))) * 100).alias("mape"),
    )
    return one.select(*by, "mae", "mse", F.sqrt("mse").alias("rmse"), F.when(F.col("spread") == 0, 0.0).otherwise(1 - F.try_divide("mse", "spread")).alias("r2"), "mape")

