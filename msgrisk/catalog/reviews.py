"""Case and feedback work over orders: an order is a case, its status and priority the review state."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.registry import query, table
from msgrisk.functions import text as tx
from msgrisk.operators import reviews as ops

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'in_progress' ELSE 'pending' END"
_VERDICT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'phishing' WHEN '2-HIGH' THEN 'legitimate' WHEN '3-MEDIUM' THEN 'uncertain' END"
_REASON = "CASE WHEN o_totalprice > 300000 THEN 'false_alert' WHEN o_totalprice > 150000 THEN 'missed_threat' WHEN o_totalprice > 50000 THEN 'other' END"
_BASIS = "CASE WHEN o_custkey % 3 = 0 THEN 'retained_message' WHEN o_custkey % 3 = 1 THEN 'external_verification' ELSE 'report_only' END"


def cases(spark, d):
    s, p, t, c = (F.col(x) for x in ("o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(s == "F", "closed").when(s == "O", "in_progress").otherwise("pending").alias("status"),
        F.when(p == "1-URGENT", "phishing").when(p == "2-HIGH", "legitimate").when(p == "3-MEDIUM", "uncertain").alias("verdict"),
        F.when(t > 300000, "false_alert").when(t > 150000, "missed_threat").when(t > 50000, "other").alias("feedback_reason"),
        F.when(c % 3 == 0, "retained_message").when(c % 3 == 1, "external_verification").otherwise("report_only").alias("evidence_basis"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), (s != "P").alias("source_consent"),
        F.lit("user_feedback").alias("record_kind"), (t > 100000).alias("evaluation_consent"), F.lit("content").alias("input_mode"),
        F.when(p == "5-LOW", "User feedback · other").otherwise("Order").alias("subject"), c.cast("string").alias("body"),
        F.lit(None).cast("string").alias("eml_base64"), F.lit(1).alias("source_schema"), F.array(F.lit("r1"), p).alias("reviewers"), c.alias("custkey"))


_CASES = f"""k AS (SELECT o_orderkey AS id, {_STATUS} AS status, {_VERDICT} AS verdict, {_REASON} AS reason, {_BASIS} AS basis, o_orderdate AS created_at,
  o_orderstatus <> 'P' AS source_consent, o_totalprice > 100000 AS evaluation_consent, o_orderpriority, o_custkey FROM orders)"""


@query("case_filter", f"WITH {_CASES} SELECT id, verdict FROM k WHERE status = 'closed' AND reason = 'false_alert' AND created_at::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def case_filter(spark, d):
    return ops.filter_cases(cases(spark, d), status="closed", reason="false_alert", created_from="1996-01-01", created_to="1997-06-30").select("id", "verdict")


@query("case_page", f"WITH {_CASES} SELECT id, status, created_at FROM k ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50")
def case_page(spark, d):
    return ops.page(cases(spark, d), 25, 50).select("id", "status", "created_at")


@query("case_queue_page", f"""WITH {_CASES},
u AS (SELECT id, created_at, 'case' AS kind FROM k WHERE status <> 'closed' UNION ALL SELECT id, created_at, 'feedback' FROM k WHERE status = 'closed')
SELECT id, created_at, kind FROM u ORDER BY created_at DESC, id DESC LIMIT 100""")
def case_queue_page(spark, d):
    c = cases(spark, d).select("id", "created_at", "status")
    return ops.merge_case_queues(100, 0, case=c.where("status <> 'closed'").drop("status"), feedback=c.where("status = 'closed'").drop("status"))


@query("retention_candidates", f"WITH {_CASES} SELECT id FROM k WHERE status = 'closed' AND created_at::DATE < DATE '1998-01-01'")
def retention_candidates(spark, d):
    return ops.retention_candidates(cases(spark, d), "1998-01-01").select("id")


@query("review_consistent", f"""WITH {_CASES}
SELECT id, NOT ((reason = 'false_alert' AND verdict IS DISTINCT FROM 'legitimate') OR (reason = 'missed_threat' AND verdict IS DISTINCT FROM 'phishing')) OR reason IS NULL AS consistent FROM k""")
def review_consistent(spark, d):
    return cases(spark, d).select("id", ops.review_consistent().alias("consistent"))


@query("feedback_overview", f"""WITH {_CASES}
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE status = 'pending')::BIGINT AS pending, count(*) FILTER (WHERE status = 'in_progress')::BIGINT AS in_progress,
  count(*) FILTER (WHERE status = 'closed')::BIGINT AS closed,
  count(*) FILTER (WHERE status = 'closed' AND (basis = 'external_verification' OR (basis = 'retained_message' AND source_consent)) AND reason = 'false_alert' AND verdict = 'legitimate')::BIGINT AS false_alerts,
  count(*) FILTER (WHERE status = 'closed' AND (basis = 'external_verification' OR (basis = 'retained_message' AND source_consent)) AND reason = 'missed_threat' AND verdict = 'phishing')::BIGINT AS missed_threats FROM k""")
def feedback_overview(spark, d):
    return ops.feedback_overview(cases(spark, d))


_R = f"""{_CASES},
r AS (SELECT *, CASE WHEN NOT (evaluation_consent AND source_consent) THEN 'no_evaluation_consent' WHEN status <> 'closed' OR verdict IS NULL OR verdict = 'uncertain' THEN 'not_closed_or_labeled'
  WHEN (reason = 'false_alert' AND verdict <> 'legitimate') OR (reason = 'missed_threat' AND verdict <> 'phishing') THEN 'inconsistent_review'
  WHEN reason IS NULL OR basis = 'report_only' THEN 'unstructured_review' WHEN o_orderpriority = '5-LOW' THEN 'ambiguous_legacy_subject' END AS why FROM k),
g AS (SELECT o_custkey, min(id) AS id, arg_min(verdict, id) AS label, min(verdict) <> max(verdict) AS conflict, count(*) AS n FROM r WHERE why IS NULL GROUP BY o_custkey)"""


@query("feedback_export_reasons", f"""WITH {_R}
SELECT why AS reason, count(*)::BIGINT AS n FROM r WHERE why IS NOT NULL GROUP BY why
UNION ALL SELECT 'conflicting_labels', coalesce(sum(n) FILTER (WHERE conflict), 0)::BIGINT FROM g UNION ALL SELECT 'duplicates', coalesce(sum(n - 1) FILTER (WHERE NOT conflict), 0)::BIGINT FROM g
UNION ALL SELECT 'exported', (count(*) FILTER (WHERE NOT conflict))::BIGINT FROM g""")
def feedback_export_reasons(spark, d):
    reasoned = ops.feedback_reason(cases(spark, d))
    merged = ops.merge_duplicate_reports(reasoned.where("reason IS NULL"))
    return ops.exclusion_counts(reasoned, merged)


@query("merged_reports", f"WITH {_R} SELECT id, label, conflict, n::BIGINT AS copies FROM g")
def merged_reports(spark, d):
    reasoned = ops.feedback_reason(cases(spark, d))
    return ops.merge_duplicate_reports(reasoned.where("reason IS NULL")).select("id", "label", "conflict", "copies")


@query("merged_report_reviewers", f"WITH {_R} SELECT count(*)::BIGINT AS pairs FROM (SELECT DISTINCT o_custkey, unnest(['r1', o_orderpriority]) FROM r WHERE why IS NULL)")
def merged_report_reviewers(spark, d):
    reasoned = ops.feedback_reason(cases(spark, d))
    return ops.merged_report_members(reasoned.where("reason IS NULL"))[1].agg(F.count(F.lit(1)).alias("pairs"))


@query("review_violations", f"""WITH {_CASES},
v AS (SELECT id, [CASE WHEN status = 'closed' AND verdict IS NULL THEN 'verdict_required' END,
  CASE WHEN status = 'closed' AND reason IS NULL THEN 'reason_and_basis_required' END,
  CASE WHEN status = 'closed' AND ((reason = 'false_alert' AND verdict IS DISTINCT FROM 'legitimate') OR (reason = 'missed_threat' AND verdict IS DISTINCT FROM 'phishing')) THEN 'reason_disagrees' END,
  CASE WHEN status = 'closed' AND basis = 'report_only' AND verdict IS DISTINCT FROM 'uncertain' THEN 'report_only_is_uncertain' END] AS a FROM k)
SELECT id, list_filter(a, lambda x: x IS NOT NULL) AS violations FROM v""")
def review_violations(spark, d):
    reviews = cases(spark, d).select(
        "id", F.lit("in_progress").alias("previous_status"), F.regexp_replace("status", "pending", "in_progress").alias("status"), F.lit(None).cast("string").alias("previous_verdict"),
        "verdict", F.lit("checked").alias("note"), F.lit(True).alias("feedback"), "feedback_reason", "evidence_basis", "source_consent", F.lit(1).alias("version"), F.lit(1).alias("expected_version"))
    return ops.review_violations(reviews).select("id", "violations")


@query("feedback_violations", """
SELECT event_id, CASE event_type WHEN 'click' THEN []::VARCHAR[] WHEN 'error' THEN ['source_missing'] WHEN 'purchase' THEN ['source_without_consent'] WHEN 'signup' THEN ['wrong_source_fields'] ELSE ['invalid_type', 'inline_data'] END AS violations FROM events""")
def feedback_violations(spark, d):
    return ops.feedback_violations(_reports(spark, d)).select("event_id", "violations")


def _reports(spark, d):
    e = F.col("event_type")
    text = F.concat(F.lit("text "), F.col("user_id").cast("string"))
    none = F.lit(None).cast("map<string,string>")
    source = F.when(e == "error", none).when(e == "signup", F.create_map(F.lit("email"), text)).when(
        e == "view", F.create_map(F.lit("body"), F.concat(F.lit("data:x "), text))).otherwise(F.create_map(F.lit("subject"), F.lit("Hi"), F.lit("body"), text))
    return table(spark, d, "events").select(
        "event_id", F.when(e == "view", "novel").otherwise("false_positive").alias("report_type"), F.lit("n").alias("note"), (e != "purchase").alias("include_source"),
        F.lit(False).alias("evaluation_consent"), F.lit("content").alias("input_mode"), F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("input_fingerprint"),
        F.lit("low").alias("risk_level"), source.alias("source"))


@query("feedback_rows", "SELECT event_id, 'Hi' AS title, 'text ' || user_id AS body, 'user_feedback' AS record_kind FROM events WHERE event_type = 'click'")
def feedback_rows(spark, d):
    return ops.feedback_rows(_reports(spark, d)).select("event_id", "title", "body", "record_kind")


@query("annotation_violations", f"""WITH {_CASES},
a AS (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'development' ELSE 'holdout' END AS role, 'f' || (o_custkey // 10) AS fam FROM k WHERE verdict IN ('phishing', 'legitimate')),
f AS (SELECT fam, min(role) <> max(role) AS split FROM a GROUP BY fam)
SELECT id, status <> 'closed' AS unknown_id, split AS family_in_two_roles FROM a JOIN f USING (fam)""")
def annotation_violations(spark, d):
    c = cases(spark, d).where("verdict IN ('phishing', 'legitimate')")
    draft = c.where("status = 'closed'").select("id", F.col("verdict").alias("label"), F.array(F.lit("r1")).alias("case_reviewer_ids"))
    notes = c.select(
        "id", F.lit("r2").alias("independent_reviewer"), F.concat(F.lit("f"), F.floor(F.col("custkey") / 10)).alias("family_id"), F.lit("gmail").alias("provider"),
        F.lit("en").alias("language"), F.date_format("created_at", "yyyy-MM-dd").alias("received_at"), F.when(F.col("custkey") % 2 == 0, "development").otherwise("holdout").alias("cohort_role"), F.col("verdict").alias("label"))
    out = ops.join_annotations(draft, notes)
    return out.select("id", F.array_contains("violations", "unknown_id").alias("unknown_id"), F.array_contains("violations", "family_in_two_roles").alias("family_in_two_roles"))


@query("case_titles", f"""WITH {_CASES} SELECT id, CASE WHEN verdict IS NULL THEN CASE status WHEN 'closed' THEN 'Untitled message' ELSE 'User feedback · other' END ELSE verdict END AS title FROM k""")
def case_titles(spark, d):
    kind = F.when(F.col("status") == "closed", "case").otherwise("user_feedback")
    return cases(spark, d).select("id", tx.case_title(F.coalesce("verdict", F.lit(" ")), kind, F.lit("other")).alias("title"))


@query("auxiliary_inputs", r"""
SELECT doc_id, CASE WHEN length(text) <= 12000 THEN 'prepared' ELSE 'skipped' END AS aux_status FROM documents""")
def auxiliary_inputs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("").alias("subject"), F.col("text").alias("body"), F.array().cast("array<string>").alias("ocr_texts"))
    return ops.auxiliary_input(docs).select("doc_id", "aux_status")


@query("message_previews", """
SELECT conv_id, sum(length(text))::BIGINT + 2 * (count(*) - 1) AS chars, false AS truncated FROM conversations GROUP BY conv_id""")
def message_previews(spark, d):
    parts = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return ops.message_preview(parts, ["conv_id"], "turn").select("conv_id", F.length("preview").cast("bigint").alias("chars"), "truncated")


@query("opinion_events", """
WITH o AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, min(event_id) AS ord, count(*) AS n FROM events GROUP BY 1, 2, 3),
f AS (SELECT user_id, k, arg_min(event_type, ord) AS first FROM o GROUP BY 1, 2)
SELECT user_id AS case_id, k AS receipt_id, ord, CASE WHEN event_type = first THEN 'saved' ELSE 'conflict' END AS outcome, n - 1 AS replays FROM o JOIN f USING (user_id, k)""")
def opinion_events(spark, d):
    names = ["credential_request", "payment_redirection", "authority_pressure", "phishing_intent", "insufficient_evidence"]
    opinions = table(spark, d, "events").select(
        F.col("user_id").alias("case_id"), F.lit("a").alias("actor"), F.get_json_object("props", "$.k").alias("receipt_id"), F.col("event_id").alias("ord"),
        F.lit("2024").alias("requested_at"), F.col("event_type").alias("model"), F.lit("x").alias("input_sha256"), F.lit(False).alias("evidence_incomplete"),
        F.struct(*[F.lit(0.5).alias(n) for n in names]).alias("probabilities"))
    open_cases = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.lit("pending").alias("status"), F.lit("case").alias("record_kind")).distinct()
    return ops.opinion_events(opinions, open_cases).drop("actor")
