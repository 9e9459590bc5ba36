"""Corpus files in their published layouts, read with explicit schemas.

Every reader yields ``text, label, group_id, source, row_ord``; ``row_ord`` is unique and follows
the order of files by name and of rows inside a file, which one task reads from front to back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.functions import text as tx

CSV = {"header": "true", "multiLine": "true", "escape": '"', "mode": "PERMISSIVE"}
# Fixed value: subjects of mailbox records that are no messages.
CONTROL_RECORDS = r"(?i)FOLDER INTERNAL DATA|MAILER-DAEMON|DELIVERY FAILURE"


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    """All columns as text; types are applied by the caller with failures as null."""
    rows = spark.read.options(**{**CSV, **options}).csv(path)
    position = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    return rows.withColumn("_row_ord", F.concat_ws("\x1f", F.col("_metadata.file_path"), position))


def _finish(rows: DataFrame, source: str, text: Column, label: Column, group: Column, *more: Column) -> DataFrame:
    return rows.select(text.alias("text"), label.alias("label"), group.alias("group_id"), F.lit(source).alias("source"),
                       F.concat_ws("\x1f", F.lit(source), "_row_ord").alias("row_ord"), *more)


def _subject_body(subject: str, body: str) -> Column:
    return tx.strip(F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(body), F.lit(""))))


def scan_typed_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    rows = _read(spark, path)
    label = F.when(F.col("Email Type") == "Phishing Email", 1).when(F.col("Email Type") == "Safe Email", 0)
    rows = rows.where(F.coalesce(tx.strip("Email Text"), F.lit("")) != "").where(label.isNotNull())
    return _finish(rows, source, F.col("Email Text"), label, tx.family_id("Email Text"))


def scan_subject_body_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    label = F.expr("try_cast(label AS INT)")
    rows = _read(spark, path).where(F.col("body").isNotNull() & label.isNotNull()).withColumn("_text", _subject_body("subject", "body"))
    rows = rows.where((F.length("_text") > 20) & ~F.col("_text").rlike(CONTROL_RECORDS))
    return _finish(rows, source, F.col("_text"), label, tx.family_id("_text"))


def scan_json_payload_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Subject and body inside a JSON column; rows with broken JSON are skipped."""
    payload = F.from_json("email_content", "subject STRING, body STRING, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    label = F.expr("try_cast(phish_label AS INT)")
    rows = _read(spark, path).withColumn("_p", payload).where(F.col("_p").isNotNull() & F.col("_p._corrupt").isNull() & label.isNotNull())
    rows = rows.withColumn("_text", tx.strip(F.concat(F.coalesce("_p.subject", F.lit("")), F.lit("\n\n"), F.coalesce("_p.body", F.lit("")))))
    rows = rows.where(F.length("_text") >= 20)
    url, ident = F.lower(tx.strip(F.coalesce("url_raw", F.lit("")))), tx.strip(F.coalesce("id", F.lit("")))
    group = (
        F.when((url != "") & (url != "nan"), F.concat(F.lit(f"{source}:url:"), F.substring(F.sha2(url, 256), 1, 20)))
        .when(ident != "", F.concat(F.lit(f"{source}:id:"), ident))
        .otherwise(tx.family_id("_text"))
    )
    return _finish(rows, source, F.col("_text"), label, group)


def scan_three_class_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    rows = _read(spark, path).where(F.col("Body").isNotNull() & F.col("Type").isin("Phishing", "Valid"))
    rows = rows.withColumn("_text", _subject_body("Subject", "Body")).where(F.length("_text") > 20)
    group = F.concat(F.lit(f"{source}:"), "Original_ID") if "Original_ID" in rows.columns else tx.family_id("_text")
    return _finish(rows, source, F.col("_text"), (F.col("Type") == "Phishing").cast("int"), group)


def scan_dated_corpus(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Dated rows; an unreadable date becomes null and the row counts as undated."""
    rows = _read(spark, path, sep=";", encoding="UTF-8")
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    missing = {"hash", "subject", "body", "date", "Label"} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    label = F.expr("CAST(try_cast(Label AS DOUBLE) AS INT)")
    rows = rows.withColumn("_text", _subject_body("subject", "body"))
    rows = rows.where(label.isin(0, 1) & (F.length("_text") > 20) & (F.coalesce(tx.strip("hash"), F.lit("")) != ""))
    date = F.coalesce(F.try_to_timestamp("date"), F.try_to_timestamp("date", F.lit("yyyy-MM-dd")))
    return _finish(rows, source, F.col("_text"), label, tx.family_id("_text"), date.alias("observed_at"))


def verify_source_digests(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """Per expected ``(name, sha256)``: ``ok``, ``mismatch`` or ``absent``.

    Files are hashed where they are read; only digests travel.
    """
    found = spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    joined = expected.join(found, "name", "left")
    status = F.when(F.col("actual").isNull(), "absent").when(F.col("actual") == F.col("sha256"), "ok").otherwise("mismatch")
    return joined.select("name", "sha256", "actual", status.alias("status"))


def scan_feature_table(spark: SparkSession, path: str, features: list[str], label: str = "result") -> DataFrame:
    """Numeric feature columns by lower-cased name; unreadable values are 0, rows without a label drop out."""
    rows = _read(spark, path).drop("_row_ord")
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    number = lambda c: F.expr(f"CAST(try_cast(trim(`{c}`) AS DOUBLE) AS INT)")
    present = [f for f in features if f in rows.columns]
    return rows.select(*[F.coalesce(number(f), F.lit(0)).alias(f) for f in present], number(label).alias(label)).na.drop(subset=[label])
