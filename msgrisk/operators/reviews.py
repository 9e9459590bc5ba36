"""Cases, reviews and user feedback: queues, rules as violation codes, curation, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.functions import text as tx
from msgrisk.functions.hashing import tagged_digest
from msgrisk.functions.stats import LEVELS
from msgrisk.operators.history import TRANSITIONS

STATUSES = list(TRANSITIONS)
VERDICTS = ["phishing", "legitimate", "uncertain"]
# Review reasons, evidence bases and report types.
REASONS = ["false_alert", "missed_threat", "risk_level", "evidence_error", "no_issue_found", "insufficient_evidence", "other"]
BASES = ["retained_message", "external_verification", "report_only"]
REPORT_TYPES = ["false_positive", "false_negative", "incorrect_risk", "incorrect_evidence", "other"]
REQUIRED_VERDICT = {"false_alert": "legitimate", "missed_threat": "phishing", "insufficient_evidence": "uncertain"}
SOURCE_FIELDS = {"sender": ["email"], "content": ["subject", "body"], "eml": ["eml_base64"], "image": ["ocr_text", "qr_text"]}
FIELD_BYTES = {"email": 320, "subject": 500, "body": 50_000, "eml_base64": 80_000, "ocr_text": 12_000, "qr_text": 4_000}
MAX_EML = 60_000


def codes(conditions: dict[str, Column]) -> Column:
    """Names of the violated rules; a null condition is not a violation."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def _in(column: str, values) -> Column:
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def filter_cases(cases: DataFrame, status=None, risk=None, verdict=None, reason=None, created_from=None, created_to=None, kind=None) -> DataFrame:
    """Optional predicates, all of them; dates are inclusive. Everything reaches the scan."""
    for column, value in (("status", status), ("risk", risk), ("verdict", verdict), ("feedback_reason", reason), ("kind", kind)):
        if value:
            cases = cases.where(F.col(column) == value)
    if created_from:
        cases = cases.where(F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    if created_to:
        cases = cases.where(F.col("created_at") < F.lit(created_to).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return cases


def page(cases: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """Newest first; ``limit`` cases after the first ``offset``. Deep pages are cheaper by ``page_after``."""
    return cases.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(max(1, limit))


def page_after(cases: DataFrame, created_at, case_id, limit: int = 25) -> DataFrame:
    """The page behind the case ``(created_at, case_id)``: only its own rows are sorted out, whatever its depth."""
    last = F.struct(F.lit(created_at).cast("timestamp").alias("t"), F.lit(case_id).alias("i"))
    return page(cases.where(F.struct(F.col("created_at").cast("timestamp").alias("t"), F.col("id").alias("i")) < last), limit)


def merge_case_queues(limit: int = 25, offset: int = 0, **queues: DataFrame) -> DataFrame:
    """One page over several queues, each row tagged with its kind."""
    tagged = [q.withColumn("kind", F.lit(k)) for k, q in queues.items()]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    return page(union, limit, offset)


def retention_candidates(cases: DataFrame, before: str) -> DataFrame:
    return cases.where((F.col("status") == "closed") & (F.to_date("updated_at") < F.lit(before).cast("date")))


def review_consistent(verdict="verdict", reason="feedback_reason") -> Column:
    wrong = [(F.col(reason) == r) & ~F.col(verdict).eqNullSafe(F.lit(v)) for r, v in REQUIRED_VERDICT.items()]
    bad = F.lit(False)
    for w in wrong:
        bad = bad | F.coalesce(w, F.lit(False))
    return ~bad


def feedback_overview(cases: DataFrame) -> DataFrame:
    """Totals by status, and the closed findings that evidence supports."""
    supported = (F.col("evidence_basis") == "external_verification") | (
        (F.col("evidence_basis") == "retained_message") & F.col("source_consent"))
    settled = (F.col("status") == "closed") & F.coalesce(supported, F.lit(False))
    found = lambda reason: settled & (F.col("feedback_reason") == reason) & (F.col("verdict") == REQUIRED_VERDICT[reason])
    return cases.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count_if(found("false_alert")).alias("false_alerts"), F.count_if(found("missed_threat")).alias("missed_threats"),
    )


def review_violations(reviews: DataFrame) -> DataFrame:
    """Rule codes per review ``(previous_status, status, previous_verdict, verdict, note, feedback,
    feedback_reason, evidence_basis, source_consent, version, expected_version)``."""
    closing, note = F.col("status") == "closed", F.trim(F.coalesce("note", F.lit("")))
    legal = F.concat_ws(">", "previous_status", "status").isin([f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs])
    feedback, plain = F.col("feedback"), ~F.col("feedback")
    given = F.col("feedback_reason").isNotNull() | F.col("evidence_basis").isNotNull()
    return reviews.withColumn("violations", codes({
        "invalid_status": ~_in("status", STATUSES),
        "invalid_verdict": F.col("verdict").isNotNull() & ~_in("verdict", VERDICTS),
        "note_too_long": F.length("note") > 4000,
        "stale_version": F.col("version") != F.col("expected_version"),
        "illegal_transition": _in("status", STATUSES) & ~legal,
        "verdict_required": closing & F.col("verdict").isNull(),
        "invalid_reason": feedback & F.col("feedback_reason").isNotNull() & ~_in("feedback_reason", REASONS),
        "invalid_basis": feedback & F.col("evidence_basis").isNotNull() & ~_in("evidence_basis", BASES),
        "reason_and_basis_required": feedback & closing & (F.col("feedback_reason").isNull() | F.col("evidence_basis").isNull()),
        "reason_disagrees": feedback & closing & ~review_consistent(),
        "note_required_to_close": feedback & closing & (note == ""),
        "report_only_is_uncertain": feedback & closing & (F.col("evidence_basis") == "report_only") & ~F.col("verdict").eqNullSafe(F.lit("uncertain")),
        "source_not_retained": feedback & closing & (F.col("evidence_basis") == "retained_message") & ~F.coalesce("source_consent", F.lit(False)),
        "feedback_fields_on_case": plain & given,
        "nothing_changed": (F.col("status") == F.col("previous_status")) & F.col("verdict").eqNullSafe(F.col("previous_verdict")) & (note == "") & ~given,
        "verdict_change_needs_note": ~F.col("verdict").eqNullSafe(F.col("previous_verdict")) & (note == ""),
    }))


def feedback_violations(reports: DataFrame) -> DataFrame:
    """Rule codes per report; ``source`` is a map of field to text."""
    source, mode = F.col("source"), F.col("input_mode")
    present = F.map_filter(F.coalesce(source, F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v != "", F.lit(False)))
    keys = F.map_keys(F.coalesce(source, F.create_map().cast("map<string,string>")))
    allowed = F.lit(False)
    for m, fields in SOURCE_FIELDS.items():
        allowed = allowed | ((mode == m) & (F.size(F.array_except(keys, tx.literals(fields))) == 0))
    oversized = F.lit(False)
    for field, limit in FIELD_BYTES.items():
        oversized = oversized | F.coalesce(F.octet_length(F.element_at(present, field)) > limit, F.lit(False))
    inline = F.exists(F.map_entries(present), lambda e: (e["key"] != "eml_base64") & F.lower(e["value"]).contains("data:"))
    raw = F.try_to_binary(F.element_at(present, "eml_base64"), F.lit("base64"))
    included = F.coalesce("include_source", F.lit(False))
    return reports.withColumn("violations", codes({
        "invalid_type": ~_in("report_type", REPORT_TYPES),
        "invalid_mode": ~_in("input_mode", SOURCE_FIELDS),
        "invalid_risk": ~_in("risk_level", [*LEVELS, "unknown"]),
        "note_too_long": F.length("note") > 2000,
        "invalid_fingerprint": ~F.coalesce(F.col("input_fingerprint").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False)),
        "evaluation_needs_source": F.coalesce("evaluation_consent", F.lit(False)) & (~included | ~mode.isin("content", "eml")),
        "source_without_consent": ~included & source.isNotNull(),
        "source_missing": included & (F.size(present) == 0),
        "wrong_source_fields": included & source.isNotNull() & ~allowed,
        "source_too_large": included & oversized,
        "inline_data": included & inline,
        "invalid_eml": included & (mode == "eml") & F.coalesce(raw.isNull() | ~F.octet_length(raw).between(1, MAX_EML), F.lit(True)),
    }))


def feedback_rows(reports: DataFrame) -> DataFrame:
    """Valid reports as case-shaped rows: title, text by mode, provenance, request digest."""
    ok = feedback_violations(reports).where(F.size("violations") == 0)
    source = F.coalesce("source", F.create_map().cast("map<string,string>"))
    get = lambda k: F.try_element_at(source, F.lit(k))
    mode = F.col("input_mode")
    eml = F.substring(F.decode(F.try_to_binary(get("eml_base64"), F.lit("base64")), "UTF-8"), 1, MAX_EML)
    body = F.when(mode == "sender", get("email")).when(mode == "content", get("body")).when(mode == "eml", eml).otherwise(
        F.concat_ws("\n", F.nullif(get("ocr_text"), F.lit("")), F.nullif(get("qr_text"), F.lit(""))))
    subject = F.coalesce(F.when(mode == "content", get("subject")), F.lit(""))
    canonical = F.to_json(F.struct("evaluation_consent", "include_source", "input_fingerprint", "input_mode", "note", "report_type", "risk_level", "source"))
    return ok.select(
        *[c for c in reports.columns if c not in {"source"}],
        tx.case_title(subject, F.lit("user_feedback"), F.col("report_type")).alias("title"),
        subject.alias("subject"), F.coalesce(body, F.lit("")).alias("body"), get("eml_base64").alias("eml_base64"),
        F.lit("user_feedback").alias("record_kind"), F.lit(2).alias("source_schema"), F.sha2(canonical, 256).alias("input_sha256"),
    )


def feedback_reason(cases: DataFrame) -> DataFrame:
    """Why each feedback case is not exported; null when it is eligible. First rule wins."""
    consent = F.coalesce((F.col("record_kind") == "user_feedback") & F.col("evaluation_consent") & F.col("source_consent"), F.lit(False))
    content = F.col("input_mode") == "content"
    eml = F.try_to_binary("eml_base64", F.lit("base64"))
    usable = F.when(content, F.coalesce(F.trim(F.concat_ws("", "subject", "body")) != "", F.lit(False))).when(
        F.col("input_mode") == "eml", F.coalesce(F.octet_length(eml).between(1, MAX_EML), F.lit(False))).otherwise(F.lit(False))
    reason = (
        F.when(~consent, "no_evaluation_consent")
        .when((F.col("status") != "closed") | ~_in("verdict", ["phishing", "legitimate"]), "not_closed_or_labeled")
        .when(~review_consistent(), "inconsistent_review")
        .when(F.col("feedback_reason").isNull() | ~_in("evidence_basis", BASES[:2]), "unstructured_review")
        .when(content & tx.ambiguous_legacy_subject("subject", "source_schema"), "ambiguous_legacy_subject")
        .when(~usable, "invalid_source")
    )
    return cases.withColumn("reason", reason)


def with_content_digest(eligible: DataFrame) -> DataFrame:
    payload = F.when(F.col("input_mode") == "eml", F.try_to_binary("eml_base64", F.lit("base64"))).otherwise(
        F.encode(F.to_json(F.struct("body", "subject")), "UTF-8"))
    return eligible.withColumn("content_sha256", tagged_digest(F.col("input_mode"), payload))


def merge_duplicate_reports(eligible: DataFrame) -> DataFrame:
    """One row per message content: least id, its label, copies; disagreeing labels are marked."""
    return with_content_digest(eligible).groupBy("input_mode", "content_sha256").agg(
        F.min("id").alias("id"), F.min_by("verdict", "id").alias("label"), (F.min("verdict") != F.max("verdict")).alias("conflict"),
        F.count(F.lit(1)).alias("copies"),
    )


def merged_report_members(eligible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source cases and distinct reviewers per message content, in long form.

    Content reported very often never has to fit in one row.
    """
    keyed = with_content_digest(eligible)
    cases = keyed.select("input_mode", "content_sha256", F.col("id").alias("source_case_id"))
    reviewers = keyed.select("input_mode", "content_sha256", F.explode("reviewers").alias("case_reviewer_id")).distinct()
    return cases, reviewers


def exclusion_counts(reasoned: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows per exclusion reason, including duplicates, conflicts and what was exported."""
    by_reason = reasoned.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    agreed = ~F.col("conflict")
    extra = merged.agg(
        F.sum(F.when(F.col("conflict"), F.col("copies")).otherwise(0)).alias("conflicting_labels"),
        F.sum(F.when(agreed, F.col("copies") - 1).otherwise(0)).alias("duplicates"), F.count_if(agreed).alias("exported"))
    long = extra.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("reason"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("n")) for n in ("conflicting_labels", "duplicates", "exported")
    ])).alias("e")).select("e.*")
    return by_reason.unionByName(long)


_NAME = r"^[A-Za-z0-9][A-Za-z0-9._@-]{0,127}$"


def join_annotations(draft: DataFrame, annotations: DataFrame) -> DataFrame:
    """Independent annotations against the draft, every violation as a code.

    A family in both roles is found by one aggregation per family, not by comparing rows.
    """
    families = annotations.groupBy("family_id").agg((F.min("cohort_role") != F.max("cohort_role")).alias("_split"))
    repeats = annotations.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    d = draft.select("id", F.col("label").alias("_draft_label"), "case_reviewer_ids")
    joined = annotations.join(repeats, "id").join(d, "id", "left").join(families, "family_id", "left")
    shaped = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    return joined.withColumn("violations", codes({
        "unknown_id": F.col("_draft_label").isNull(),
        "duplicate_id": F.col("_repeated"),
        "reviewer_not_independent": ~shaped("independent_reviewer", _NAME) | F.array_contains("case_reviewer_ids", F.col("independent_reviewer")),
        "invalid_family": ~shaped("family_id", _NAME),
        "family_in_two_roles": F.coalesce("_split", F.lit(False)),
        "invalid_provider": ~_in("provider", ["gmail", "outlook"]),
        "invalid_language": ~shaped("language", "^[a-z]{2,3}$"),
        "invalid_date": ~tx.is_calendar_date("received_at"),
        "invalid_role": ~_in("cohort_role", ["development", "holdout"]),
        "label_disagrees": F.col("label") != F.col("_draft_label"),
    })).drop("_draft_label", "case_reviewer_ids", "_split", "_repeated")


def cohort_roles(annotated: DataFrame) -> DataFrame:
    """Rows that pass every check, by cohort role."""
    return annotated.where(F.size("violations") == 0).drop("violations", "independent_reviewer")


def opinion_events(opinions: DataFrame, cases: DataFrame) -> DataFrame:
    """Auxiliary opinions judged against their case: saved once per (actor, receipt).

    Opinions are first collapsed per distinct content, so replays cost nothing.
    """
    p = ["credential_request", "payment_redirection", "authority_pressure", "phishing_intent", "insufficient_evidence"]
    bad = F.lit(False)
    for name in p:
        value = F.col(f"probabilities.{name}")
        bad = bad | ~F.coalesce(~F.isnan(value) & value.between(0.0, 1.0), F.lit(False))
    content = F.sha2(F.to_json(F.struct("requested_at", "model", "input_sha256", "probabilities", "evidence_incomplete")), 256)
    distinct = opinions.withColumn("content", content).groupBy("case_id", "actor", "receipt_id", "content").agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("copies"), F.first(bad).alias("invalid"))
    firsts = distinct.groupBy("case_id", "actor", "receipt_id").agg(F.min_by("content", "ord").alias("accepted"))
    judged = distinct.join(firsts, ["case_id", "actor", "receipt_id"]).join(cases.select("case_id", "status", "record_kind"), "case_id", "left")
    outcome = (
        F.when(F.col("invalid"), "invalid").when(F.col("status").isNull(), "unknown_case")
        .when(F.col("content") != F.col("accepted"), "conflict")
        .when((F.col("status") == "closed") | (F.col("record_kind") == "user_feedback"), "case_not_open").otherwise("saved"))
    return judged.select("case_id", "actor", "receipt_id", "ord", outcome.alias("outcome"), (F.col("copies") - 1).alias("replays"))


def case_snapshot(messages: DataFrame, verdicts: DataFrame, key: list[str], scoring_version: str, max_chars: int = 60_000) -> DataFrame:
    """Immutable evidence row per message: bounded source, analysis, provenance."""
    m = messages.select(*key, F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body"))
    return m.join(verdicts, key).withColumns({
        "text_truncated": F.length("body") > max_chars, "body": F.substring("body", 1, max_chars),
        "title": tx.case_title("subject", F.lit("case"), F.lit(None).cast("string")), "scoring_version": F.lit(scoring_version),
    })


def auxiliary_input(cases: DataFrame, max_chars: int = 12_000) -> DataFrame:
    """Redacted text for a second opinion; over-long inputs are skipped, never cut."""
    ocr = F.transform(F.coalesce("ocr_texts", F.array().cast("array<string>")),
                      lambda t: F.concat(F.lit("\n[Unverified OCR text; may contain spelling errors]\n"), t))
    body = tx.mask_inline_data(F.concat(F.coalesce("body", F.lit("")), F.array_join(ocr, "")))
    subject = tx.mask_inline_data(F.coalesce("subject", F.lit("")))
    size = F.length(subject) + F.length(body)
    usable = (F.trim(F.concat(subject, body)) != "") & (size <= max_chars)
    red = cases.select("*", F.when(usable, tx.redact(subject)).alias("aux_subject"), F.when(usable, tx.redact(body)).alias("aux_body"),
                       F.when(usable, "prepared").otherwise("skipped").alias("aux_status"))
    return red.withColumn("request_digest", F.when(F.col("aux_status") == "prepared", F.sha2(F.concat_ws("\x1f", "aux_subject", "aux_body"), 256)))


def message_preview(parts: DataFrame, key: list[str], order: str, budget: int = 60_000) -> DataFrame:
    """Masked visible text of all parts in order under one budget, with a truncation flag."""
    from msgrisk.operators.rules import bounded_text

    masked = parts.select(*key, order, tx.mask_inline_data("text").alias("text"))
    # Parts past the budget are empty and are not gathered, so a preview is a bounded row.
    cut = bounded_text(masked.withColumn("_message", F.struct(*key)), "_message", order, "text", budget).drop("_message")
    joined = cut.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(order, "text")))).alias("_p"), F.max("truncated").alias("truncated"))
    return joined.select(*key, F.array_join(F.transform("_p", lambda x: x["text"]), "\n\n").alias("preview"), "truncated")
