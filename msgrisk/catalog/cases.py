"""Review writes with a version check, made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.registry import query, table
from msgrisk.operators import cases


def attempts(spark, d):
    """Every event of a user is a write to that user's case, made for one of six versions."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("case_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 6).alias("expected_version"),
        F.when(kind == "purchase", "closed").when(kind == "error", "pending").otherwise("in_progress").alias("status"),
        F.when(F.col("value") > 20, "phishing").when(F.col("value") > 8, "legitimate").alias("verdict"))


@query("case_attempts", """
WITH RECURSIVE a AS (SELECT user_id::VARCHAR AS case_id, event_id AS seq, event_id % 6 AS expected,
    CASE event_type WHEN 'purchase' THEN 'closed' WHEN 'error' THEN 'pending' ELSE 'in_progress' END AS status,
    CASE WHEN value > 20 THEN 'phishing' WHEN value > 8 THEN 'legitimate' END AS verdict,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT DISTINCT case_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome, 0::BIGINT AS version, 'pending' AS current, NULL::VARCHAR AS known FROM a
  UNION ALL
  SELECT case_id, k, seq, outcome, CASE WHEN outcome = 'applied' THEN version + 1 ELSE version END, CASE WHEN outcome = 'applied' THEN status ELSE current END,
    CASE WHEN outcome = 'applied' THEN verdict ELSE known END FROM (
    SELECT a.case_id, a.k, a.seq, s.version, s.current, s.known, a.status, a.verdict,
      CASE WHEN a.expected <> s.version THEN 'conflict'
        WHEN NOT (s.current = 'pending' AND a.status IN ('pending', 'in_progress') OR s.current = 'in_progress' AND a.status IN ('in_progress', 'closed') OR s.current = 'closed' AND a.status = 'in_progress') THEN 'invalid_transition'
        WHEN a.status = 'closed' AND a.verdict IS NULL THEN 'verdict_required'
        WHEN a.status = s.current AND a.verdict IS NOT DISTINCT FROM s.known THEN 'unchanged' ELSE 'applied' END AS outcome
    FROM s JOIN a ON a.case_id = s.case_id AND a.k = s.k + 1))
SELECT case_id, seq, outcome, version AS case_version, current AS case_status, known AS case_verdict FROM s WHERE k > 0""")
def case_attempts(spark, d):
    return cases.case_attempts(attempts(spark, d)).select("case_id", "seq", "outcome", "case_version", "case_status", "case_verdict")
