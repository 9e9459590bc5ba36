"""Evaluation reports. Orders stand in for evaluated messages: priority is the risk, status the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.registry import query, sql_wilson, table
from msgrisk.functions import stats
from msgrisk.operators import evaluate as ops

DIMS = ["provider", "language", "month"]

# Risk level of an order priority.
RISK = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unknown", "5-LOW": "low"}


def outcomes(spark, d):
    orders = table(spark, d, "orders")
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = orders.join(customer, "o_custkey").join(nation, "c_nationkey")
    risk = F.element_at(F.create_map(*[F.lit(x) for p in RISK.items() for x in p]), F.col("o_orderpriority"))
    return rows.select(
        "o_orderkey",
        F.col("c_mktsegment").alias("provider"),
        F.concat(F.lit("r"), F.col("n_regionkey")).alias("language"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.when(F.col("o_orderstatus") == "F", "phishing").otherwise("legitimate").alias("label"),
        stats.decision(risk).alias("decision"),
        (F.col("o_totalprice") > 100000).alias("complete"),
        (F.col("o_orderstatus") != "P").alias("ml_available"),
    )


_OUT = """o AS (SELECT o_orderkey, c_mktsegment AS provider, 'r' || n_regionkey AS language, strftime(o_orderdate, '%Y-%m') AS month,
  CASE WHEN o_orderstatus = 'F' THEN 'phishing' ELSE 'legitimate' END AS label,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'undetermined' WHEN '5-LOW' THEN 'not_alerted' ELSE 'alerted' END AS decision,
  o_totalprice > 100000 AS complete, o_orderstatus <> 'P' AS ml_available
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def _sql_counts():
    cells = [
        f"count(*) FILTER (WHERE label = '{w}' AND decision = '{x}')::BIGINT AS {w}_{x}"
        for w in ("phishing", "legitimate") for x in ("alerted", "not_alerted", "undetermined")
    ]
    return ", ".join([
        "count(*)::BIGINT AS n", "count(*) FILTER (WHERE label = 'phishing')::BIGINT AS phishing_count",
        "count(*) FILTER (WHERE label = 'legitimate')::BIGINT AS legitimate_count", *cells,
        "count(*) FILTER (WHERE decision = 'undetermined')::BIGINT AS unknown_count",
        "count(*) FILTER (WHERE complete)::BIGINT AS complete_count",
        "count(*) FILTER (WHERE ml_available)::BIGINT AS ml_available_count",
    ])


def _sql_rates():
    out = []
    for name, (s, n) in ops.RATES.items():
        out.append(f"round({s}::DOUBLE / nullif({n}, 0), 6) AS {name}")
        out.append(f"round({sql_wilson(s, n, False)}, 6) AS {name}_low")
        out.append(f"round({sql_wilson(s, n, True)}, 6) AS {name}_high")
    return ", ".join(out)


@query("evaluation_counts", f"WITH {_OUT} SELECT {_sql_counts()} FROM o")
def evaluation_counts(spark, d):
    return ops.evaluation_counts(outcomes(spark, d))


@query("evaluation_cube", f"""WITH {_OUT},
c AS (SELECT provider, language, month, concat_ws(',', CASE WHEN grouping(provider) = 0 THEN 'provider' END,
  CASE WHEN grouping(language) = 0 THEN 'language' END, CASE WHEN grouping(month) = 0 THEN 'month' END) AS dim_set, {_sql_counts()}
  FROM o GROUP BY CUBE (provider, language, month))
SELECT *, {_sql_rates()} FROM c""")
def evaluation_cube(spark, d):
    return ops.evaluation_cube(outcomes(spark, d), DIMS)


@query("evaluation_by", f"""WITH {_OUT},
c AS (SELECT coalesce(CASE WHEN grouping(provider) = 0 THEN 'provider' END, CASE WHEN grouping(language) = 0 THEN 'language' END, 'month') AS dim,
  coalesce(provider, language, month) AS value, {_sql_counts()} FROM o GROUP BY GROUPING SETS ((provider), (language), (month)))
SELECT *, {_sql_rates()} FROM c""")
def evaluation_by(spark, d):
    return ops.evaluation_by(outcomes(spark, d), DIMS)


@query("report_accounting_check", f"""WITH {_OUT} SELECT '' AS dim_set, provider, language, month FROM o WHERE 1 = 0""")
def report_accounting_check(spark, d):
    """A correct report has no mismatching group."""
    return ops.report_accounting_check(ops.evaluation_cube(outcomes(spark, d), DIMS), DIMS)


def _candidate(spark, d):
    """The same orders judged by a stricter rule: low priority with a high price alerts too."""
    base = outcomes(spark, d)
    stricter = F.when((F.col("decision") == "not_alerted") & F.col("complete"), "alerted").otherwise(F.col("decision"))
    return base.withColumn("decision", stricter)


def _comparison(spark, d):
    base = ops.evaluation_cube(outcomes(spark, d), ["provider", "language"])
    cand = ops.evaluation_cube(_candidate(spark, d), ["provider", "language"])
    return ops.compare_reports(base, cand, ["dim_set", "provider", "language"])


_GATE = f"""WITH {_OUT},
k AS (SELECT *, CASE WHEN decision = 'not_alerted' AND complete THEN 'alerted' ELSE decision END AS d2 FROM o),
b AS (SELECT provider, language, concat_ws(',', CASE WHEN grouping(provider) = 0 THEN 'provider' END, CASE WHEN grouping(language) = 0 THEN 'language' END) AS dim_set,
 {_sql_counts()} FROM o GROUP BY CUBE (provider, language)),
c AS (SELECT provider, language, concat_ws(',', CASE WHEN grouping(provider) = 0 THEN 'provider' END, CASE WHEN grouping(language) = 0 THEN 'language' END) AS dim_set,
 {_sql_counts()} FROM (SELECT provider, language, label, d2 AS decision, complete, ml_available FROM k) GROUP BY CUBE (provider, language)),
j AS (""" + " UNION ALL ".join(
    f"SELECT b.dim_set, b.provider, b.language, '{m}' AS metric, b.{m} AS baseline, c.{m} AS candidate, {s} AS direction FROM b JOIN c "
    f"ON b.dim_set = c.dim_set AND b.provider IS NOT DISTINCT FROM c.provider AND b.language IS NOT DISTINCT FROM c.language"
    for m, s in ops.DIRECTIONS.items()) + """),
r AS (SELECT dim_set, provider, language, metric, baseline, candidate, candidate - baseline AS delta,
  CASE WHEN (candidate - baseline) * direction < 0 THEN 'regression' ELSE 'ok' END AS status FROM j)"""


@query("compare_reports", _GATE + " SELECT * FROM r")
def compare_reports(spark, d):
    return _comparison(spark, d)


@query("regression_gate", _GATE + """
SELECT count(*)::BIGINT AS checked, count(*) FILTER (WHERE status = 'regression')::BIGINT AS regressions, 0::BIGINT AS incomparable,
  count(*) > 0 AND count(*) FILTER (WHERE status = 'regression') = 0 AS passed FROM r""")
def regression_gate(spark, d):
    config = {"verification_mode": "off"}
    return ops.regression_gate(_comparison(spark, d), config, dict(config))


@query("dataset_fingerprint", """
WITH h AS (SELECT sha256(doc_id || '|' || sha256(text) || '|' || lang || '|' || source) AS h FROM documents),
s AS (SELECT count(*) AS n, """ + ", ".join(
    f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::HUGEINT AS s{i}" for i in range(4)) + """ FROM h)
SELECT n::BIGINT AS n_rows, sha256('documents-v1|' || n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS fingerprint FROM s""")
def dataset_fingerprint(spark, d):
    record = F.concat_ws("|", F.col("doc_id").cast("string"), F.sha2("text", 256), "lang", "source")
    return ops.multiset_fingerprint(table(spark, d, "documents"), record, "documents-v1")


@query("shadow_aggregate", f"""WITH {_OUT},
a AS (SELECT o.*, CASE WHEN l.o_orderstatus <> 'P' THEN round(l.o_totalprice / 600000, 4) END AS p, l.o_totalprice < 50000 AS weak FROM o JOIN orders l USING (o_orderkey)),
x AS (SELECT *, CASE WHEN p IS NULL OR weak OR NOT complete THEN 'undetermined' WHEN p >= 0.5 THEN 'alerted' ELSE 'not_alerted' END AS aux FROM a),
y AS (SELECT *, CASE WHEN decision = 'alerted' OR aux = 'alerted' THEN 'alerted' ELSE decision END AS shadow FROM x)
SELECT language, count(*)::BIGINT AS n, count(*) FILTER (WHERE label = 'phishing')::BIGINT AS phishing_count,
  count(*) FILTER (WHERE label = 'legitimate')::BIGINT AS legitimate_count, """ + ", ".join(
    f"count(*) FILTER (WHERE label = '{w}' AND {col} = 'alerted')::BIGINT AS {v}_{w}_alerted"
    for v, col in (("baseline", "decision"), ("auxiliary", "aux"), ("shadow", "shadow")) for w in ("phishing", "legitimate")) + """,
  count(*) FILTER (WHERE label = 'phishing' AND decision <> 'alerted' AND shadow = 'alerted')::BIGINT AS recovered_phishing,
  count(*) FILTER (WHERE label = 'legitimate' AND decision <> 'alerted' AND shadow = 'alerted')::BIGINT AS new_legitimate_alerts,
  count(p)::BIGINT AS brier_n, round(avg(power(p - (label = 'phishing')::INTEGER, 2)), 6) AS brier_score,
  count(*) FILTER (WHERE p IS NOT NULL)::BIGINT AS available FROM y GROUP BY language""")
def shadow_aggregate(spark, d):
    price = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    rows = outcomes(spark, d).join(price, "o_orderkey")
    p = F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 600000, 4))
    weak = F.when(F.col("o_totalprice") < 50000, 0.9).otherwise(0.1)
    rows = rows.withColumn("probability", p).withColumn(
        "auxiliary", ops.auxiliary_decision(p, weak, ~F.col("complete"), 0.5)
    ).withColumnRenamed("decision", "baseline")
    rows = rows.withColumn("shadow", ops.or_decision(F.col("baseline"), F.col("auxiliary"))).withColumn(
        "status", F.when(F.col("probability").isNotNull(), "available").otherwise("unavailable")
    )
    out = ops.shadow_aggregate(rows, ["language"])
    return out.withColumn("brier_score", F.round("brier_score", 6))


@query("usage_totals", """
SELECT count(*)::BIGINT AS reported_calls, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS input_tokens, sum(user_id)::BIGINT AS output_tokens,
  count(DISTINCT event_type)::BIGINT AS models, count(DISTINCT sha256(event_type))::BIGINT AS question_sets FROM events""")
def usage_totals(spark, d):
    calls = table(spark, d, "events").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"), F.col("user_id").alias("output_tokens"),
        F.col("event_type").alias("model"), F.sha2("event_type", 256).alias("questions_sha256"),
    )
    return ops.usage_totals(calls)
