"""Evaluation over time and the staged corpus build."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from msgrisk.catalog.corpus import documents
from msgrisk.catalog.metrics import _S, scored
from msgrisk.catalog.registry import query, sql_family_id, table
from msgrisk.functions.stats import Z95
from msgrisk.plans import build, temporal
from msgrisk.session import ensure_checkpoint_dir

CUTOFF, HOLDOUT, MAX_FPR = "1996-01-01", "1997-01-01", 0.15
_Z2 = Z95 * Z95


def _bound(s: str, n: str, sign: str) -> str:
    limit, edge = ("least(1.0, ", f"WHEN {s} = {n} THEN 1.0") if sign == "+" else ("greatest(0.0, ", f"WHEN {s} = 0 THEN 0.0")
    rate = f"({s}::DOUBLE / {n})"
    return (f"CASE WHEN {n} = 0 THEN NULL {edge} ELSE {limit}({rate} + {_Z2} / (2 * {n}) {sign} {Z95} * sqrt({rate} * (1 - {rate}) / {n} + {_Z2} / (4.0::DOUBLE * {n} * {n}))) "
            f"/ (1 + {_Z2} / {n})) END")


_RATES = ["accuracy", "precision", "recall", "fpr", "f1", "fpr_low", "fpr_high", "recall_low", "recall_high", "pr_auc", "brier"]
_DATED = f"""{_S}, p AS (SELECT s.*, o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '{HOLDOUT}' THEN 'holdout' WHEN o_orderdate >= TIMESTAMP '{CUTOFF}' THEN 'validation'
  ELSE 'train' END AS part FROM s JOIN orders USING (o_orderkey))"""


@query("temporal_evaluation", f"""
WITH {_DATED},
g AS (SELECT part, score, sum(label)::BIGINT AS pos, count(*) AS n FROM p WHERE part <> 'train' GROUP BY part, score),
c AS (SELECT part, score, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS alerts, sum(pos) OVER (PARTITION BY part) AS positives,
  sum(n - pos) OVER (PARTITION BY part) AS negatives FROM g WINDOW w AS (PARTITION BY part ORDER BY score DESC)),
best AS (SELECT score AS threshold FROM c WHERE part = 'validation' AND (alerts - tp)::DOUBLE / negatives <= {MAX_FPR} ORDER BY tp DESC, alerts, score LIMIT 1),
t AS (SELECT greatest(threshold, 0.05) AS threshold FROM best),
a AS (SELECT part, sum(pos::DOUBLE / positives * tp / alerts) AS pr_auc FROM c GROUP BY part),
n AS (SELECT part, any_value(threshold) AS threshold, count(*) AS n, sum(label)::BIGINT AS positives, sum(1 - label)::BIGINT AS negatives,
  count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS false_positives,
  count(*) FILTER (WHERE score < threshold AND label = 1) AS false_negatives, avg(power(score - label, 2)) AS brier FROM p, t WHERE part <> 'train' GROUP BY part),
o AS (SELECT x.part, count(DISTINCT x.o_custkey) AS group_overlap FROM p x JOIN p y ON x.o_custkey = y.o_custkey
  AND (x.part = 'holdout' AND y.part <> 'holdout' OR x.part = 'validation' AND y.part = 'train') GROUP BY x.part)
SELECT part AS slice, CASE part WHEN 'holdout' THEN 'evaluated' ELSE 'used-for-threshold-selection' END AS status, threshold, n, positives, negatives, tp, false_positives, false_negatives,
  round((n - false_positives - false_negatives)::DOUBLE / n, 6) AS accuracy, round(tp::DOUBLE / (tp + false_positives), 6) AS precision, round(tp::DOUBLE / positives, 6) AS recall,
  round(false_positives::DOUBLE / negatives, 6) AS fpr, round(2.0::DOUBLE * tp / (2 * tp + false_positives + false_negatives), 6) AS f1,
  round({_bound("false_positives", "negatives", "-")}, 6) AS fpr_low, round({_bound("false_positives", "negatives", "+")}, 6) AS fpr_high,
  round({_bound("tp", "positives", "-")}, 6) AS recall_low, round({_bound("tp", "positives", "+")}, 6) AS recall_high,
  round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier, coalesce(group_overlap, 0) AS group_overlap
FROM n JOIN a USING (part) LEFT JOIN o USING (part)""")
def temporal_evaluation(spark, d):
    dated = scored(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("observed_at")), "o_orderkey")
    out = temporal.temporal_evaluation(dated, CUTOFF, HOLDOUT, MAX_FPR, group="o_custkey")
    return out.select(*[F.round(c, 6).alias(c) if c in _RATES else c for c in out.columns])


def build_inputs(spark, d):
    """Two corpora of labelled documents, conversations for training only, passages as hard negatives, the rest reserved."""
    docs = documents(spark, d).withColumn("group_id", F.concat("lang", F.lit("/"), "source"))
    known = docs.where("label IS NOT NULL")
    turns = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_ord"), F.lit("conversations").alias("source"), F.concat(F.lit("conv/"), F.col("conv_id")).alias("group_id"),
        (F.col("role") == "system").cast("int").alias("label"), "text")
    passages = table(spark, d, "benchmark").select(
        F.col("item_id").alias("row_ord"), F.lit("benchmark").alias("source"), F.concat(F.lit("en/src"), F.col("item_id") % 20).alias("group_id"),
        F.lit(0).alias("label"), "text")
    return [known.where("lang = 'en'"), known.where("lang <> 'en'")], turns, passages, docs.where("label IS NULL")


@query("corpus_pipeline_counts", f"""
WITH l AS (SELECT (lang <> 'en')::INTEGER AS rank, doc_id, lang || '/' || source AS grp, toxic AS label, {sql_family_id('text')} AS family FROM documents JOIN labels USING (doc_id)),
f AS (SELECT family, min((rank, doc_id)) AS first FROM l GROUP BY family HAVING min(label) = max(label)),
k AS (SELECT l.* FROM l JOIN f ON l.family = f.family AND (l.rank, l.doc_id) = f.first),
g AS (SELECT grp, min(label) AS lo, max(label) AS hi FROM k GROUP BY grp),
h AS (SELECT grp, (row_number() OVER (PARTITION BY lo, hi ORDER BY sha256('42:' || grp), grp) - 1) % 5 = 0 AS test FROM g),
s AS (SELECT k.*, test FROM k JOIN h USING (grp)),
held AS (SELECT {sql_family_id('text')} AS family FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
e0 AS (SELECT conv_id * 1000 + turn AS ord, (role = 'system')::INTEGER AS label, {sql_family_id('text')} AS family FROM conversations),
e AS (SELECT family, arg_min(label, ord) AS label FROM e0 WHERE family NOT IN (SELECT family FROM s UNION SELECT family FROM held) GROUP BY family),
n0 AS (SELECT {sql_family_id('text')} AS family FROM benchmark WHERE 'en/src' || (item_id % 20) NOT IN (SELECT grp FROM h WHERE test)),
n AS (SELECT DISTINCT family FROM n0 WHERE family NOT IN (SELECT family FROM s UNION SELECT family FROM held UNION SELECT family FROM e)),
c AS (SELECT 0 AS ord, 'united' AS stage, count(*) AS rows, sum(label) AS positives, 0 AS held_out FROM l
  UNION ALL SELECT 1, 'deduplicated', count(*), sum(label), 0 FROM k
  UNION ALL SELECT 2, 'split', count(*), sum(label), count(*) FILTER (WHERE test) FROM s
  UNION ALL SELECT 3, 'extra', count(*), coalesce(sum(label), 0), 0 FROM e
  UNION ALL SELECT 4, 'with_extra', (SELECT count(*) FROM s) + (SELECT count(*) FROM e), (SELECT sum(label) FROM s) + (SELECT coalesce(sum(label), 0) FROM e), (SELECT count(*) FROM s WHERE test)
  UNION ALL SELECT 5, 'hard_negatives', count(*), 0, 0 FROM n
  UNION ALL SELECT 6, 'corpus', (SELECT count(*) FROM s) + (SELECT count(*) FROM e) + (SELECT count(*) FROM n),
    (SELECT sum(label) FROM s) + (SELECT coalesce(sum(label), 0) FROM e), (SELECT count(*) FROM s WHERE test))
SELECT ord::INTEGER AS ord, stage, rows::BIGINT AS rows, positives::BIGINT AS positives, held_out::BIGINT AS held_out, false AS cached, true AS cached_again, true AS same_lineage FROM c""")
def corpus_pipeline_counts(spark, d):
    """The build, and a second build that finds every stage in the cache."""
    folder = f"{ensure_checkpoint_dir(spark)}/stages-{uuid.uuid4().hex}"
    first, again = (build.build_corpus_pipeline(*build_inputs(spark, d), build.StageCache(spark, folder))[1] for _ in range(2))
    second = again.select("stage", F.col("cached").alias("cached_again"), F.col("lineage").alias("_l"))
    return first.join(second, "stage").select("ord", "stage", "rows", "positives", "held_out", "cached", "cached_again", (F.col("lineage") == F.col("_l")).alias("same_lineage"))
