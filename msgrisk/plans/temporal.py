"""Evaluation over time: a threshold is chosen on one dated slice, frozen, and judged on a later one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.functions.stats import ratio, wilson_high, wilson_low
from msgrisk.operators import metrics
from msgrisk.operators.corpus import temporal_partition

SLICES = ("validation", "holdout")


def temporal_evaluation(
    scored: DataFrame, cutoff: str, holdout_start: str, max_fpr: float, observed_at: str = "observed_at", label: str = "label",
    score: str = "score", group: str | None = None, floor: float = 0.05, fallback: float = 0.5,
) -> DataFrame:
    """One row for the validation and one for the holdout slice, both at the threshold of the validation slice.

    ``scored`` has a date, a 0/1 label and a score. Rows from ``holdout_start`` on are the holdout, from ``cutoff`` on the
    validation, older and undated ones the training slice, which only counts for ``group_overlap``: groups that a slice
    shares with an earlier one. The threshold has the most recall within ``max_fpr`` false positives, never below ``floor``;
    it may exclude every row. A validation slice without both classes chooses nothing: ``fallback`` holds then. Null scores
    are never alerts; null labels are left out. An empty slice has zero counts and null rates.
    """
    placed = scored.where(F.col(label).isin(0, 1)).withColumn("_slice", temporal_partition(F.col(observed_at), cutoff, holdout_start))
    known = placed.where(F.col(score).isNotNull())
    curves = {s: metrics.pr_curve(known.where(F.col("_slice") == s), label, score) for s in SLICES}
    chosen = metrics.select_threshold_at_fpr(curves["validation"], max_fpr)
    both = curves["validation"].agg((F.max("positives") > 0) & (F.max("negatives") > 0)).first()[0]  # one flag
    selected = F.greatest(F.col("threshold"), F.lit(floor)) if both else F.lit(max(floor, fallback))
    frozen = chosen.select(selected.alias("threshold"))  # one row
    counted = placed.where(F.col("_slice") != "train").crossJoin(F.broadcast(frozen))
    alert, bad = F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False)), F.col(label) == 1
    counts = counted.groupBy("_slice").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("positives"), F.count_if(~bad).alias("negatives"),
        F.count_if(alert & bad).alias("tp"), F.count_if(alert & ~bad).alias("false_positives"), F.count_if(~alert & bad).alias("false_negatives"),
        F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"),
    )
    areas = reduce(DataFrame.unionByName, [
        metrics.average_precision(curves[s]).select(F.lit(s).alias("_slice"), F.col("average_precision").alias("pr_auc")) for s in SLICES])
    every = scored.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SLICES)], "_slice string, _ord int")
    out = every.crossJoin(F.broadcast(frozen)).join(counts, "_slice", "left").join(areas, "_slice", "left")
    if group is None:
        out = out.withColumn("group_overlap", F.lit(None).cast("bigint"))
    else:
        rank = F.when(F.col("_slice") == "holdout", 2).when(F.col("_slice") == "validation", 1).otherwise(0)
        sides = placed.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(rank).alias("_from"), F.collect_set("_slice").alias("_in"))  # three slices
        shared = sides.select("_from", F.explode("_in").alias("_slice")).where((F.col("_slice") != "train") & (F.col("_from") < rank))
        out = out.join(shared.groupBy("_slice").agg(F.count(F.lit(1)).alias("group_overlap")), "_slice", "left")
    numbers = ["n", "positives", "negatives", "tp", "false_positives", "false_negatives", *(["group_overlap"] if group else [])]
    out = out.na.fill(0, numbers)
    status = F.when(F.col("_slice") == "holdout", F.when(F.col("n") > 0, "evaluated").otherwise("unavailable")).otherwise(
        F.lit("used-for-threshold-selection" if both else "unavailable"))
    return out.orderBy("_ord").select(
        F.col("_slice").alias("slice"), status.alias("status"), "threshold", "n", "positives", "negatives", "tp", "false_positives", "false_negatives",
        ratio(F.col("n") - F.col("false_positives") - F.col("false_negatives"), "n").alias("accuracy"),
        ratio("tp", F.col("tp") + F.col("false_positives")).alias("precision"), ratio("tp", "positives").alias("recall"),
        ratio("false_positives", "negatives").alias("fpr"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("false_positives") + F.col("false_negatives")).alias("f1"),
        wilson_low("false_positives", "negatives").alias("fpr_low"), wilson_high("false_positives", "negatives").alias("fpr_high"),
        wilson_low("tp", "positives").alias("recall_low"), wilson_high("tp", "positives").alias("recall_high"), "pr_auc", "brier", "group_overlap",
    )
