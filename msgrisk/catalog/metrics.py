"""Curves, thresholds and summary metrics on scored orders and labeled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.registry import query, table
from msgrisk.operators import features
from msgrisk.operators import metrics as ops


def scored(spark, d):
    """Finished orders as the positive class, scored by their (bounded) price."""
    return table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.round(F.least(F.col("o_totalprice") / 600000, F.lit(1.0)), 4).alias("score"),
    )


_S = """s AS (SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS label,
  round(least(o_totalprice / 600000, 1.0), 4) AS score FROM orders)"""
_CURVE = f"""WITH {_S},
g AS (SELECT score AS threshold, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM s GROUP BY score),
c AS (SELECT threshold, pos, neg, (sum(pos) OVER (ORDER BY threshold DESC))::BIGINT AS tp,
  (sum(neg) OVER (ORDER BY threshold DESC))::BIGINT AS fp,
  (sum(pos) OVER ())::BIGINT AS positives, (sum(neg) OVER ())::BIGINT AS negatives FROM g),
pr AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / positives AS recall, fp::DOUBLE / negatives AS fpr FROM c)"""


@query("pr_curve", _CURVE + """
SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr""")
def pr_curve(spark, d):
    curve = ops.pr_curve(scored(spark, d))
    return curve.select("threshold", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("average_precision", _CURVE + """
SELECT round(sum(pos::DOUBLE / positives * precision), 6) AS average_precision FROM pr""")
def average_precision(spark, d):
    return ops.average_precision(ops.pr_curve(scored(spark, d))).select(F.round("average_precision", 6).alias("average_precision"))


@query("roc_auc", _CURVE + """
SELECT round(sum(neg::DOUBLE * (2.0 * (tp - pos) + pos)) / (2.0 * max(positives) * max(negatives)), 6) AS roc_auc FROM pr""")
def roc_auc(spark, d):
    return ops.roc_auc(ops.pr_curve(scored(spark, d))).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("roc_points", _CURVE + """
SELECT threshold, round(recall, 6) AS tpr, round(fpr, 6) AS fpr FROM pr""")
def roc_points(spark, d):
    points = ops.roc_points(ops.pr_curve(scored(spark, d)))
    return points.select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("threshold_f2", _CURVE + """,
f AS (SELECT threshold, 5 * precision * recall / greatest(4 * precision + recall, 1e-12) AS f2 FROM pr)
SELECT greatest(threshold, 0.05) AS threshold, round(f2, 6) AS f2 FROM f ORDER BY f.f2 DESC, f.threshold LIMIT 1""")
def threshold_f2(spark, d):
    best = ops.select_threshold_f2(ops.pr_curve(scored(spark, d)))
    return best.select("threshold", F.round("f2", 6).alias("f2"))


@query("threshold_at_fpr", _CURVE + """
SELECT threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM pr
WHERE fp::DOUBLE / negatives <= 0.15 ORDER BY tp::DOUBLE / positives DESC, fp, threshold LIMIT 1""")
def threshold_at_fpr(spark, d):
    best = ops.select_threshold_at_fpr(ops.pr_curve(scored(spark, d)), 0.15)
    return best.select("threshold", F.round("recall", 6).alias("recall"), F.round("fpr", 6).alias("fpr"))


@query("binary_metrics", f"""WITH {_S},
c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn FROM s)
SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fn::DOUBLE / nullif(tp + fn, 0), 0), 6) AS fnr,
  round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fpr FROM c""")
def binary_metrics(spark, d):
    out = ops.binary_metrics(scored(spark, d), 0.5)
    rates = ["accuracy", "precision", "recall", "f1", "fnr", "fpr"]
    return out.select("tp", "fp", "fn", "tn", *[F.round(r, 6).alias(r) for r in rates])


@query("brier_score", f"""WITH {_S}
SELECT count(score)::BIGINT AS n, round(avg(power(score - label, 2)), 6) AS brier FROM s""")
def brier_score(spark, d):
    return ops.brier_score(scored(spark, d)).select("n", F.round("brier", 6).alias("brier"))


@query("confusion_matrix", """
WITH c AS (SELECT l_returnflag AS label, CASE WHEN l_discount >= 0.05 THEN 'R' WHEN l_tax >= 0.04 THEN 'A' ELSE 'N' END AS predicted,
           count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2)
SELECT label, predicted, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY label), 6) AS share FROM c""")
def confusion_matrix(spark, d):
    out = ops.confusion_matrix(predicted_flags(spark, d))
    return out.select("label", "predicted", "n", F.round("share", 6).alias("share"))


def predicted_flags(spark, d):
    guess = F.when(F.col("l_discount") >= 0.05, "R").when(F.col("l_tax") >= 0.04, "A").otherwise("N")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), guess.alias("predicted"), "l_linestatus")


@query("weighted_metrics", """
WITH p AS (SELECT l_linestatus AS status, l_returnflag AS y, CASE WHEN l_discount >= 0.05 THEN 'R' WHEN l_tax >= 0.04 THEN 'A' ELSE 'N' END AS yhat FROM lineitem),
cls AS (SELECT DISTINCT status, y AS cls FROM p UNION SELECT DISTINCT status, yhat FROM p),
m AS (SELECT cls.status, cls.cls, count(*) FILTER (WHERE p.y = cls.cls) AS support, count(*) FILTER (WHERE p.yhat = cls.cls) AS chosen,
      count(*) FILTER (WHERE p.y = cls.cls AND p.yhat = cls.cls) AS hit FROM cls JOIN p USING (status) GROUP BY 1, 2)
SELECT status, sum(support)::BIGINT AS n,
  round(sum(coalesce(hit::DOUBLE / nullif(chosen, 0), 0) * support) / sum(support), 6) AS precision,
  round(sum(coalesce(hit::DOUBLE / nullif(support, 0), 0) * support) / sum(support), 6) AS recall,
  round(sum(coalesce(2.0 * hit / nullif(chosen + support, 0), 0) * support) / sum(support), 6) AS f1 FROM m GROUP BY status""")
def weighted_metrics(spark, d):
    pred = predicted_flags(spark, d).withColumnRenamed("l_linestatus", "status")
    out = ops.weighted_metrics(pred, by=["status"])
    return out.select("status", F.col("n").cast("bigint").alias("n"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("latency_stats", """
SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, max(value) AS max,
  quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def latency_stats(spark, d):
    out = ops.latency_stats(table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), "max", "p50", "p95")


# --- feature tables ------------------------------------------------------------------

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("correlation_matrix", "WITH x AS (SELECT * FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM x"
    for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i:]))
def correlation_matrix(spark, d):
    out = features.correlation_matrix(table(spark, d, "lineitem"), _NUMERIC)
    return out.select("feature_a", "feature_b", F.round("r", 6).alias("r"))


@query("target_correlation", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, (l_returnflag = 'R')::INTEGER)), 6) AS r FROM lineitem" for c in _NUMERIC))
def target_correlation(spark, d):
    rows = table(spark, d, "lineitem").withColumn("result", (F.col("l_returnflag") == "R").cast("int"))
    return features.target_correlation(rows, _NUMERIC, "result").select("feature", F.round("r", 6).alias("r"))


@query("group_mean_correlation", "SELECT grp, round(avg(r), 6) AS mean_r, count(*)::BIGINT AS features FROM (" + " UNION ALL ".join(
    f"SELECT '{g}' AS grp, abs(corr({c}, (l_returnflag = 'R')::INTEGER)) AS r FROM lineitem"
    for c, g in zip(_NUMERIC, ["amount", "amount", "rate", "rate", "position"])) + ") GROUP BY grp")
def group_mean_correlation(spark, d):
    rows = table(spark, d, "lineitem").withColumn("result", (F.col("l_returnflag") == "R").cast("int"))
    groups = dict(zip(_NUMERIC, ["amount", "amount", "rate", "rate", "position"]))
    out = features.group_mean_correlation(rows, groups, "result")
    return out.select("grp", F.round("mean_r", 6).alias("mean_r"), "features")


@query("top_correlated", "SELECT feature, round(r, 6) AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, (l_returnflag = 'R')::INTEGER)) AS r FROM lineitem" for c in _NUMERIC)
    + ") ORDER BY r DESC, feature LIMIT 3")
def top_correlated(spark, d):
    rows = table(spark, d, "lineitem").withColumn("result", (F.col("l_returnflag") == "R").cast("int"))
    return features.top_correlated(rows, _NUMERIC, "result", 3).select("feature", F.round("r", 6).alias("r"))


@query("value_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::VARCHAR AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY {c}"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber")))
def value_counts(spark, d):
    return features.value_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("class_profile", """
SELECT toxic AS class, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY toxic""")
def class_profile(spark, d):
    out = features.class_profile(table(spark, d, "labels"), "toxic")
    return out.select(F.col("toxic").alias("class"), "n", F.round("share", 6).alias("share"))
