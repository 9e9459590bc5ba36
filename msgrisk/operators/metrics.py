"""Classifier metrics from scored tables ``(label 0/1, score)``.

Everything starts by collapsing rows to distinct scores; curves are running totals over
those (see ``scale.cumulate``), never one global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.functions.stats import f_beta, ratio
from msgrisk.operators.scale import cumulate


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Per distinct score (as threshold, inclusive): counts, precision, recall, fpr."""
    marked = scored.select(
        F.col(score).alias("threshold"),
        (F.col(label) == 1).cast("bigint").alias("pos"),
        (F.col(label) == 0).cast("bigint").alias("neg"),
    )
    c = cumulate(marked, "threshold", ["pos", "neg"], descending=True)
    return c.select(
        "threshold",
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.col("all_pos").alias("positives"),
        F.col("all_neg").alias("negatives"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        ratio("cum_pos", "all_pos").alias("recall"),
        ratio("cum_neg", "all_neg").alias("fpr"),
    )


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of recall steps times precision; a step is the group's own positives. Null without positives."""
    step = ratio("pos", "positives")
    return curve.agg(F.sum(step * F.col("precision")).alias("average_precision"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """Rank-sum area with averaged ties, accumulated exactly in integers."""
    above = F.col("tp") - F.col("pos")
    twice = (F.col("neg").cast("decimal(19,0)") * (2 * above + F.col("pos")).cast("decimal(19,0)")).cast("decimal(38,0)")
    return curve.agg(
        (
            F.sum(twice).cast("double")
            / (2.0 * F.max("positives").cast("double") * F.max("negatives").cast("double"))
        ).alias("roc_auc")
    )


def roc_points(curve: DataFrame) -> DataFrame:
    return curve.select("threshold", F.col("recall").alias("tpr"), "fpr")


def select_threshold_f2(curve: DataFrame, floor: float = 0.05) -> DataFrame:
    """Threshold with the best F2 (lowest one on ties), never below ``floor``."""
    best = curve.withColumn("f2", f_beta("precision", "recall")).agg(
        F.max(F.struct("f2", (-F.col("threshold")).alias("neg_threshold"))).alias("best")
    )
    return best.select(
        F.greatest(-F.col("best.neg_threshold"), F.lit(floor)).alias("threshold"), F.col("best.f2").alias("f2")
    )


def select_threshold_at_fpr(curve: DataFrame, max_fpr: float) -> DataFrame:
    """Highest recall within a false-positive cap; then lower fpr, then lower threshold.

    "Predict nothing" competes as a threshold just above the highest score.
    """
    nothing = curve.agg(F.max("threshold").alias("top")).select(
        F.lit(0.0).alias("recall"),
        F.lit(0.0).alias("neg_fpr"),
        (-(F.col("top") + F.greatest(F.abs(F.col("top")), F.lit(1e-300)) * F.lit(2.0**-52))).alias("neg_threshold"),
    )
    offered = curve.where(F.col("fpr") <= max_fpr).select(
        "recall", (-F.col("fpr")).alias("neg_fpr"), (-F.col("threshold")).alias("neg_threshold")
    )
    best = offered.unionByName(nothing).agg(F.max(F.struct("recall", "neg_fpr", "neg_threshold")).alias("b"))
    return best.select(
        (-F.col("b.neg_threshold")).alias("threshold"), F.col("b.recall").alias("recall"), (-F.col("b.neg_fpr")).alias("fpr")
    )


def binary_metrics(scored: DataFrame, threshold: float, label: str = "label", score: str = "score",
                   by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates at a threshold; empty denominators give zero."""
    alert, bad = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.groupBy(*(by or [])).agg(
        F.count_if(alert & bad).alias("tp"),
        F.count_if(alert & ~bad).alias("fp"),
        F.count_if(~alert & bad).alias("fn"),
        F.count_if(~alert & ~bad).alias("tn"),
    )
    def zero(n, d):
        return F.coalesce(ratio(n, d), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *(by or []),
        "tp", "fp", "fn", "tn",
        zero(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        zero(tp, tp + fp).alias("precision"),
        zero(tp, tp + fn).alias("recall"),
        zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        zero(fn, tp + fn).alias("fnr"),
        zero(fp, fp + tn).alias("fpr"),
    )


def brier_score(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mean squared error of the non-null probabilities, with their number."""
    return scored.agg(
        F.count(score).alias("n"), F.avg(F.pow(F.col(score) - F.col(label).cast("double"), 2)).alias("brier")
    )


def confusion_matrix(pred: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Counts per (label, prediction) and their share of the label."""
    cells = pred.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(label).agg(F.sum("n").alias("label_rows"))
    return cells.join(totals, label).select(
        label, predicted, "n", (F.col("n") / F.col("label_rows")).alias("share")
    )


def weighted_metrics(pred: DataFrame, label: str = "label", predicted: str = "predicted",
                     by: list[str] | None = None) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    by = by or []
    cells = pred.groupBy(*by, label, predicted).agg(F.count(F.lit(1)).alias("n"))
    right = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)
    cells = cells.select(*by, F.col(label).alias("y"), F.col(predicted).alias("yhat"), "n")
    sides = cells.select(*by, F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).alias("chosen"),
                         right.alias("hit")).unionByName(
        cells.select(*by, F.col("yhat").alias("cls"), F.lit(0).alias("support"), F.col("n").alias("chosen"),
                     F.lit(0).alias("hit"))
    )
    per_class = sides.groupBy(*by, "cls").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hit").alias("hit")
    )
    p = F.coalesce(ratio("hit", "chosen"), F.lit(0.0))
    r = F.coalesce(ratio("hit", "support"), F.lit(0.0))
    f = F.coalesce(ratio(2 * F.col("hit"), F.col("chosen") + F.col("support")), F.lit(0.0))
    weigh = lambda m: F.sum(m * F.col("support")) / F.sum("support")
    return per_class.groupBy(*by).agg(
        F.sum("support").alias("n"), weigh(p).alias("precision"), weigh(r).alias("recall"), weigh(f).alias("f1")
    )


def latency_stats(df: DataFrame, value: str, by: list[str] | None = None, shares=(0.5, 0.95)) -> DataFrame:
    """n, mean, max and nearest-rank percentiles, exact and without holding a group in memory."""
    by = by or []
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("value"), F.lit(1).cast("bigint").alias("n"))
    ranks = cumulate(known, "value", ["n"], by)
    picks = [
        F.min(F.when(F.col("cum_n") >= F.ceil(F.col("all_n") * F.lit(s)), F.col("value"))).alias(f"p{round(s * 100)}")
        for s in shares
    ]
    return ranks.groupBy(*by).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.max("value").alias("max"),
        *picks,
    )
