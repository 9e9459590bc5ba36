"""Verdicts: rollups, fusion and the full analysis of documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.pages import KNOWN_HOSTS
from msgrisk.catalog.registry import SQL_WORD, query, table
from msgrisk.catalog.text import _MSG, passage_openings
from msgrisk.operators import fuse
from msgrisk.plans import analyze

_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'safe' END"


def priority_floor():
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", "high").when(p == "2-HIGH", "medium").otherwise("safe")


@query("message_rollup", """
WITH f AS (SELECT l_orderkey, l_returnflag || l_linestatus AS kind, max(l_linenumber) AS points,
  max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 0 END) AS rank FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, sum(points)::INTEGER AS total_score, CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'safe' END AS risk_floor,
  list(kind ORDER BY kind) AS kinds FROM f GROUP BY l_orderkey""")
def message_rollup(spark, d):
    flag = F.col("l_returnflag")
    findings = table(spark, d, "lineitem").select(
        "l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_linenumber").alias("points"),
        F.when(flag == "R", "high").when(flag == "A", "medium").otherwise("safe").alias("floor"))
    return fuse.message_rollup(findings, ["l_orderkey"])


def _scored_orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", F.floor(F.col("o_totalprice") / 30000).cast("int").alias("total_score"), priority_floor().alias("risk_floor"),
        F.when(F.col("o_orderstatus") != "P", F.round(F.least(F.col("o_totalprice") / 600000, F.lit(1.0)), 4)).alias("probability"))


_SCORED = f"""o AS (SELECT o_orderkey, floor(o_totalprice / 30000)::INTEGER AS t, {_RANK} AS f,
  CASE WHEN o_orderstatus <> 'P' THEN round(least(o_totalprice / 600000, 1.0), 4) END AS p FROM orders)"""


@query("rule_verdict", f"""WITH {_SCORED}
SELECT o_orderkey, CASE WHEN t > 15 THEN 'critical' WHEN f = 'high' THEN 'high' WHEN f = 'medium' AND t <= 8 THEN 'medium' WHEN t = 0 THEN 'safe'
  WHEN t <= 3 THEN 'low' WHEN t <= 8 THEN 'medium' ELSE 'high' END AS verdict FROM o""")
def rule_verdict(spark, d):
    return _scored_orders(spark, d).select("o_orderkey", fuse.rule_verdict("total_score", "risk_floor").alias("verdict"))


@query("fuse_risk", f"""WITH {_SCORED},
x AS (SELECT *, least(1.0, t / 16.0::DOUBLE) AS r, coalesce(p, 0.0) AS m, greatest(CASE f WHEN 'medium' THEN 0.30 WHEN 'high' THEN 0.55 ELSE 0.0 END, CASE WHEN t > 0 THEN 0.10 ELSE 0.0 END) AS fl,
  p IS NOT NULL AND p >= 0.4 AS sig, t >= 9 OR f = 'high' AS sup FROM o)
SELECT o_orderkey, CASE WHEN r >= 0.80 OR (m >= 0.80 AND sup) THEN 'critical' WHEN f = 'high' OR r >= 0.55 OR sig THEN 'high'
  WHEN greatest(r, m, fl) >= 0.30 THEN 'medium' WHEN greatest(r, m, fl) >= 0.10 THEN 'low' ELSE 'safe' END AS risk_level,
  CASE WHEN sig AND t = 0 AND f = 'safe' THEN 'model_only' WHEN sig AND NOT sup THEN 'model_led' WHEN sig THEN 'corroborated' ELSE 'other' END AS fusion_basis FROM x""")
def fuse_risk(spark, d):
    return fuse.fuse_risk(_scored_orders(spark, d), "probability", 0.4).select("o_orderkey", "risk_level", "fusion_basis")


@query("sender_contributions", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 ELSE CASE WHEN o_custkey > 0 THEN 1 ELSE 0 END END AS points,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'safe' END AS floor FROM orders""")
def sender_contributions(spark, d):
    o = table(spark, d, "orders").withColumn("v", F.regexp_replace(priority_floor(), "safe", "low"))
    return o.select("o_orderkey", fuse.sender_contribution("v", "o_custkey").alias("points"), fuse.sender_floor("v").alias("floor"))


@query("nested_rollup", """
WITH RECURSIVE g AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity::INTEGER % 12) AS s, max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 0 END) AS f,
  count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS a, count(*) FILTER (WHERE l_discount > 0.05)::BIGINT AS b FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN s > 8 THEN 3 WHEN s > 3 THEN 2 WHEN s > 0 THEN 1 ELSE 0 END AS own FROM g),
last AS (SELECT k, min(n) AS n FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.k = x.k AND y.n = x.n + 1) GROUP BY k),
fold AS (SELECT c.k, c.n, c.s, c.f, c.own, c.a, c.b FROM c JOIN last USING (k, n)
  UNION ALL
  SELECT c.k, c.n, greatest(c.s, x.s), greatest(c.f, CASE WHEN x.s > 15 THEN 4 WHEN x.f = 3 THEN 3 WHEN x.f = 2 THEN 2 WHEN x.s > 8 THEN 3 WHEN x.s > 3 THEN 2 ELSE x.own END), c.own, c.a + x.a, c.b + x.b
  FROM fold x JOIN c ON c.k = x.k AND c.n = x.n - 1)
SELECT k AS root_id, s AS total_score, ['safe', 'low', 'medium', 'high', 'critical'][f + 1] AS risk_floor,
  ['safe', 'low', 'medium', 'high', 'critical'][1 + CASE WHEN s > 15 THEN 4 WHEN f = 3 THEN 3 WHEN f = 2 THEN 2 WHEN s > 8 THEN 3 WHEN s > 3 THEN 2 ELSE own END] AS risk_level,
  a AS inline_images, b AS remote_images FROM fold WHERE n = 1""")
def nested_rollup(spark, d):
    """Line 1 of an order is the outer message; each following line is attached to the one before."""
    score, flag = F.col("l_quantity").cast("int") % 12, F.col("l_returnflag")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max(score).alias("total_score"), F.max(F.when(flag == "R", 3).when(flag == "A", 2).otherwise(0)).alias("r"),
        F.count_if(F.col("l_linestatus") == "F").alias("inline_images"), F.count_if(F.col("l_discount") > 0.05).alias("remote_images"))
    s = F.col("total_score")
    messages = lines.select(
        F.col("l_orderkey").alias("root_id"),
        F.when(F.col("l_linenumber") > 1, F.array_repeat(F.lit(0), F.col("l_linenumber") - 1)).otherwise(F.array().cast("array<int>")).alias("msg_path"),
        "total_score", F.when(F.col("r") == 3, "high").when(F.col("r") == 2, "medium").otherwise("safe").alias("risk_floor"),
        F.when(s > 8, "high").when(s > 3, "medium").when(s > 0, "low").otherwise("safe").alias("risk_level"),
        "inline_images", "remote_images", F.array().cast("array<string>").alias("warnings"))
    return fuse.nested_rollup(messages, ["inline_images", "remote_images"]).drop("warnings")


@query("best_mime_view", """
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_discount END AS p FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p IS NULL, p DESC, l_linenumber) AS k FROM v)
SELECT l_orderkey, l_linenumber, p FROM r WHERE k = 1""")
def best_mime_view(spark, d):
    views = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("p"))
    return fuse.best_mime_view(views, ["l_orderkey"], "l_linenumber", "p")


@query("visual_merge", """
WITH b AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 0 END AS own FROM orders),
i AS (SELECT l_orderkey, max(CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 1 ELSE 0 END) AS top, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey, CASE WHEN coalesce(top, 0) > own THEN CASE top WHEN 4 THEN 'critical' ELSE 'low' END WHEN n > 0 AND own = 0 THEN 'unknown'
  ELSE CASE own WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'safe' END END AS risk_level, coalesce(n, 0)::BIGINT AS images_seen FROM b LEFT JOIN i ON l_orderkey = o_orderkey""")
def visual_merge(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", priority_floor().alias("risk_level"), F.lit(1.0).alias("combined_score"),
                                            F.lit(0).alias("total_score"), F.lit("other").alias("fusion_basis"))
    flag = F.col("l_returnflag")
    seen = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("o_orderkey"), F.when(flag == "R", "critical").when(flag == "A", "low").otherwise("safe").alias("risk_level"),
        F.lit(50.0).alias("combined_score"), F.lit(3).alias("total_score"))
    return fuse.merge_visual_findings(base, seen, ["o_orderkey"]).select("o_orderkey", "risk_level", "images_seen")


@query("analyze_documents", rf"""
WITH {_MSG},
r AS (SELECT item_id AS ord, CASE WHEN length(text) > 150 THEN 'long' ELSE 'short' END AS category,
  regexp_replace(array_to_string(string_split(lower(text), ' ')[1:3], ' '), '[.,]+$', '') AS phrase FROM benchmark),
h AS (SELECT doc_id, category, least(count(*), 5) AS pts FROM m JOIN r ON contains(low, phrase)
  AND regexp_matches(low, '(^|[^{SQL_WORD}])' || regexp_escape(phrase) || '($|[^{SQL_WORD}])') GROUP BY 1, 2),
s AS (SELECT doc_id, (length(text) - length(replace(text, '!', '')) >= 3)::INTEGER
  + (length(text) > 60 AND len(regexp_extract_all(text, '\p{{Lu}}'))::DOUBLE / nullif(len(regexp_extract_all(text, '\p{{L}}')), 0) > 0.40)::INTEGER AS sig FROM m),
t AS (SELECT m.doc_id, coalesce(sig, 0) + coalesce((SELECT sum(pts) FROM h WHERE h.doc_id = m.doc_id), 0) AS total FROM m JOIN s USING (doc_id))
SELECT doc_id, total::INTEGER AS total_score, CASE WHEN total >= 13 THEN 'critical' WHEN total >= 9 THEN 'high' WHEN total >= 5 THEN 'medium' WHEN total > 0 THEN 'low' ELSE 'safe' END AS risk_level,
  true AS analysis_complete FROM t""")
def analyze_documents(spark, d):
    messages = table(spark, d, "documents").select("doc_id", F.lit("").alias("subject"), F.col("text").alias("body"), F.lit(False).alias("is_html"))
    out = analyze.analyze_messages(messages, ["doc_id"], passage_openings(spark, d), KNOWN_HOSTS)
    return out.select("doc_id", "total_score", "risk_level", "analysis_complete")


@query("analyze_pages")
def analyze_pages(spark, d):
    messages = table(spark, d, "pages").select("page_id", F.col("url").alias("subject"), F.col("html").alias("body"), F.lit(True).alias("is_html"))
    return analyze.analyze_messages(messages, ["page_id"], passage_openings(spark, d), KNOWN_HOSTS)
