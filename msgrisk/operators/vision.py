"""Scoring of text and code recognition outcomes against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.functions import text as tx
from msgrisk.functions.stats import ratio


def score_outcomes(manifest: DataFrame, outcomes: DataFrame, key: str = "id") -> DataFrame:
    """Every manifest record scored; a missing or failed outcome counts as empty output."""
    joined = manifest.alias("m").join(outcomes.alias("o"), key, "left")
    usable = F.coalesce(F.col("status"), F.lit("missing")).isin("processed", "partial")
    text = F.when(usable, F.coalesce("text", F.lit(""))).otherwise("")
    qr = F.when(usable, F.array_distinct(F.coalesce("qr_payloads", F.array().cast("array<string>")))).otherwise(
        F.array().cast("array<string>")
    )
    expected = F.col("expected_qr_payloads")
    alert = F.when(F.col("risk_level").isin("medium", "high", "critical"), "phishing").when(
        F.col("risk_level").isin("low", "safe"), "benign").when(F.col("risk_level").isNull(), "unavailable").otherwise("unknown")
    return joined.select(
        key, "language", "label",
        F.coalesce("status", F.lit("missing")).alias("status"),
        F.length("expected_text").alias("reference_characters"),
        F.length(text).alias("actual_characters"),
        F.levenshtein(F.col("expected_text"), text).alias("edit_distance"),
        (usable & (text == F.col("expected_text"))).alias("text_exact"),
        (usable & tx.exact_set(qr, expected)).alias("qr_exact"),
        F.size(expected).alias("expected_qr_count"),
        F.size(F.array_intersect(qr, expected)).alias("qr_matched_count"),
        F.size(F.array_except(qr, expected)).alias("qr_extra_count"),
        F.col("expected_urls").isNotNull().alias("urls_scored"),
        F.coalesce(usable & tx.exact_set(tx.extract_urls(text), F.col("expected_urls")), F.lit(False)).alias("urls_exact"),
        F.when(F.col("language") == "eng", F.regexp_count(text, F.lit(r"\p{IsHan}"))).otherwise(0).alias("unexpected_han_count"),
        "elapsed_ms",
        alert.alias("risk_prediction"),
        (usable & (F.col("label") != "unknown") & (alert == F.col("label"))).alias("risk_correct"),
    )


def ocr_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Error, exactness and recall rates; a rate over nothing is null."""
    def n_if(c):
        return F.count_if(c)

    def share(part, whole):
        return ratio(part, whole)

    qr_positive, english = F.col("expected_qr_count") > 0, F.col("language") == "eng"
    n = F.count(F.lit(1))
    return rows.groupBy(*(by or [])).agg(
        n.alias("count"),
        F.sum("reference_characters").alias("reference_characters"),
        F.sum("edit_distance").alias("edit_distance"),
        share(F.sum("edit_distance"), F.sum("reference_characters")).alias("character_error_rate"),
        n_if((F.col("reference_characters") == 0) & (F.col("actual_characters") > 0)).alias("empty_reference_false_text_count"),
        share(n_if(F.col("text_exact")), n).alias("text_exact_rate"),
        share(n_if(F.col("qr_exact")), n).alias("qr_exact_set_rate"),
        n_if(qr_positive).alias("qr_positive_count"),
        share(n_if(qr_positive & F.col("qr_exact")), n_if(qr_positive)).alias("qr_positive_exact_set_rate"),
        share(F.sum("qr_matched_count"), F.sum("expected_qr_count")).alias("qr_payload_recall"),
        F.sum("qr_extra_count").alias("qr_extra_payload_count"),
        share(n_if(F.col("urls_exact")), n_if(F.col("urls_scored"))).alias("url_exact_set_rate"),
        n_if(english).alias("english_count"),
        share(n_if(english & (F.col("unexpected_han_count") > 0)), n_if(english)).alias("unexpected_han_image_rate"),
        share(n_if(F.col("risk_correct")), n_if(F.col("label") != "unknown")).alias("risk_correct_rate"),
        n_if(F.col("status") == "missing").alias("missing"),
    )
