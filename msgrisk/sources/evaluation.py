"""Evaluation inputs, archives, registries and snapshots: readers that report violations as codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.functions import text as tx
from msgrisk.operators.scale import dimension_join
from msgrisk.operators.reviews import STATUSES, VERDICTS, codes
from msgrisk.functions.stats import LEVELS

EVAL_SCHEMA = ("id STRING, source_id STRING, provider STRING, label STRING, language STRING, received_at STRING, subject STRING, "
               "body STRING, raw_email STRING, eml_path STRING, content_sha256 STRING, _corrupt STRING")
MANIFEST_SCHEMA = ("schema_version INT, records STRING, exploratory_only BOOLEAN, "
                   "sources ARRAY<STRUCT<id: STRING, url: STRING, revision: STRING, license: STRING, label_basis: STRING>>")
# Fixed value: the form of a record's id.
_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def _matches(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def _given(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def read_jsonl(spark: SparkSession, path: str, schema: str = EVAL_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def eval_violations(rows: DataFrame) -> DataFrame:
    """Rule codes of private evaluation rows."""
    text_given = _given("subject") | _given("body") | _given("raw_email")
    return rows.withColumn("violations", codes({
        "invalid_json": F.col("_corrupt").isNotNull(),
        "invalid_provider": ~F.coalesce(F.col("provider").isin("gmail", "outlook"), F.lit(False)),
        "invalid_label": ~F.coalesce(F.col("label").isin("phishing", "legitimate"), F.lit(False)),
        "invalid_language": F.col("language").isNotNull() & ~_matches("language", "^[a-z]{2,3}$"),
        "invalid_date": ~tx.is_calendar_date("received_at"),
        "mixed_input": F.col("eml_path").isNotNull() & text_given,
        "relative_path": F.col("eml_path").isNotNull() & ~_matches("eml_path", "^/"),
        "content_missing": F.col("eml_path").isNull() & ~text_given,
    }))


def fail_closed(rows: DataFrame, limit: int = 5) -> DataFrame:
    """Raise with the first few codes if any row violates a rule; otherwise pass the rows on."""
    bad = rows.where(F.size("violations") > 0)
    sample = [r[0] for r in bad.select("violations").limit(limit).collect()]
    if sample:
        raise ValueError(f"{bad.count()} invalid rows, for example {sample}")
    return rows.drop("violations")


def read_eval_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return eval_violations(read_jsonl(spark, path))


def manifest_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a manifest with their rule codes; a moving revision is not provenance."""
    one = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").json(path)
    rows = one.select("schema_version", F.coalesce("exploratory_only", F.lit(True)).alias("exploratory_only"), F.explode("sources").alias("s")).select(
        "schema_version", "exploratory_only", "s.*")
    repeated = rows.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    fields = ["id", "url", "revision", "license", "label_basis"]
    blank, long = F.lit(False), F.lit(False)
    for f in fields:
        blank, long = blank | ~_given(f), long | F.coalesce(F.length(f) > 2000, F.lit(False))
    return rows.join(repeated, "id", "left").withColumn("violations", codes({
        "unsupported_version": F.col("schema_version") != 1,
        "missing_metadata": blank,
        "metadata_too_long": long,
        "invalid_id": ~_matches("id", _ID),
        "duplicate_id": F.coalesce("_repeated", F.lit(False)),
        "not_a_web_url": ~_matches("url", r"^https?://[^/?#@\s]+(?:[/?#]|$)"),
        "moving_revision": F.lower(F.trim("revision")).isin("main", "master", "head", "latest", "unknown"),
    })).drop("_repeated")


def manifest_records(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Records against their manifest: unique ids, known sources, matching content digests."""
    ids = rows.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    known = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("_known")).distinct()
    payload = F.to_json(F.array(F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))
    digest = F.sha2(payload, 256)
    shaped = lambda c: F.col(c).isNull() | _matches(c, "^[a-z][a-z0-9_-]{1,39}$")
    joined = dimension_join(rows.join(ids, "id", "left"), known, ["source_id"], "left", ["id"])
    return joined.withColumn("violations", codes({
        "invalid_json": F.col("_corrupt").isNotNull(),
        "invalid_id": ~_matches("id", _ID),
        "duplicate_id": F.coalesce("_repeated", F.lit(False)),
        "unknown_source": F.col("_known").isNull(),
        "invalid_label": ~F.coalesce(F.col("label").isin("phishing", "legitimate"), F.lit(False)),
        "invalid_provider": ~shaped("provider"),
        "invalid_language": ~shaped("language"),
        "invalid_date": F.col("received_at").isNotNull() & ~tx.is_calendar_date("received_at"),
        "mixed_input": F.col("eml_path").isNotNull() & (_given("subject") | _given("body")),
        "content_missing": F.col("eml_path").isNull() & (F.trim(F.concat_ws("", "subject", "body")) == ""),
        "content_digest": F.col("eml_path").isNull() & F.col("content_sha256").isNotNull() & (F.col("content_sha256") != digest),
    })).drop("_repeated", "_known").withColumns({
        "provider": F.coalesce("provider", F.lit("unknown")), "language": F.coalesce("language", F.lit("unknown")), "content_digest": digest,
    })


# --- registries and snapshots --------------------------------------------------------

_DOMAIN = r"^(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"


def build_domain_registry(lines: DataFrame, column: str = "value") -> DataFrame:
    """Normalized distinct domains from text lines with ``#`` comments."""
    name = F.regexp_replace(F.lower(tx.strip(F.substring_index(F.col(column), "#", 1))), r"\.+$", "")
    return lines.select(name.alias("domain")).where("domain <> ''").distinct()


def validate_registry(registry: DataFrame, version: str, domain_count: int, others: DataFrame | None = None) -> DataFrame:
    """One row of violation counts; all zero means the registry may be used."""
    d = F.col("domain")
    normal = F.regexp_replace(F.lower(tx.strip("domain")), r"\.+$", "")
    counts = registry.agg(F.count(F.lit(1)).alias("_n"), F.count_if(d != normal).alias("not_normalized"), F.count_if(~d.rlike(_DOMAIN)).alias("malformed"))
    repeats = registry.groupBy("domain").count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicates"))
    dated = F.lit(version).rlike(r"^\d{4}\.\d{2}\.\d{2}$") & F.try_to_date(F.lit(version), "yyyy.MM.dd").isNotNull()
    out = counts.crossJoin(repeats).select(
        "not_normalized", "malformed", "duplicates", (F.col("_n") != domain_count).cast("bigint").alias("count_mismatch"),
        (~F.coalesce(dated, F.lit(False))).cast("bigint").alias("invalid_version"))
    if others is None:
        return out.withColumn("shared_with_other", F.lit(0).cast("bigint"))
    shared = registry.select("domain").distinct().join(others.select("domain").distinct(), "domain", "left_semi")
    return out.crossJoin(shared.agg(F.count(F.lit(1)).alias("shared_with_other")))


def scan_domain_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    schema = "domain STRING, kind STRING, values ARRAY<STRING>, status STRING, observed_at TIMESTAMP"
    return spark.read.format(fmt).schema(schema).load(path)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


# --- case archives -------------------------------------------------------------------

CASE_SCHEMA = ("id STRING, title STRING, risk STRING, status STRING, verdict STRING, version INT, created_at STRING, updated_at STRING, created_by STRING, "
               "input_sha256 STRING, events ARRAY<STRUCT<actor: STRING, action: STRING, note: STRING, happened_at: STRING, changes: STRING>>, "
               "analysis STRUCT<risk_level: STRING>")
SUMMARY = ["title", "risk", "status", "verdict", "version"]


def archive_integrity(fields: DataFrame) -> DataFrame:
    """Mismatch codes per case from archive rows ``(field, value)``.

    ``r:`` rows hold records, ``s:`` rows summaries, the others request mappings; the three
    sides are aligned with one aggregation per case id.
    """
    kind = F.when(F.col("field").startswith("r:"), "record").when(F.col("field").startswith("s:"), "summary").otherwise("request")
    rows = fields.select(kind.alias("kind"), F.substring("field", 3, 400).alias("_suffix"), "value")
    request = F.from_json("value", "id STRING, digest STRING")
    ident = F.when(F.col("kind") == "request", request["id"]).otherwise(F.col("_suffix"))
    rows = rows.select("kind", ident.alias("id"), "value", request["digest"].alias("digest"))
    side = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    aligned = rows.groupBy("id").agg(
        side("record", "value").alias("_r"), side("summary", "value").alias("_s"), side("request", "digest").alias("digest"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("record", "summary", "request")])
    r, s = F.from_json("_r", CASE_SCHEMA), F.from_json("_s", CASE_SCHEMA)
    parsed = aligned.withColumns({"r": r, "s": s})
    differs = F.lit(False)
    for c in SUMMARY:
        differs = differs | ~F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    inside = lambda c, vs: F.coalesce(F.col(c).isin(vs), F.lit(False))
    return parsed.select("id", codes({
        "record_missing": F.col("n_record") == 0,
        "summary_missing": F.col("n_summary") == 0,
        "request_missing": F.col("n_request") == 0,
        "duplicate_request": F.col("n_request") > 1,
        "invalid_risk": (F.col("n_record") > 0) & ~inside("r.risk", [*LEVELS, "unknown"]),
        "invalid_status": (F.col("n_record") > 0) & ~inside("r.status", STATUSES),
        "invalid_verdict": F.col("r.verdict").isNotNull() & ~inside("r.verdict", VERDICTS),
        "version_mismatch": F.col("r.version") != F.size("r.events"),
        "risk_mismatch": ~F.col("r.analysis.risk_level").eqNullSafe(F.col("r.risk")),
        "summary_mismatch": (F.col("n_summary") > 0) & (F.col("n_record") > 0) & differs,
        "digest_mismatch": (F.col("n_request") > 0) & ~F.col("digest").eqNullSafe(F.col("r.input_sha256")),
        "invalid_digest": (F.col("n_record") > 0) & ~F.coalesce(F.col("r.input_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
    }).alias("violations"))


# --- sinks ---------------------------------------------------------------------------


def write_cohort(cohort: DataFrame, path: str) -> None:
    """JSON lines per cohort role."""
    cohort.write.partitionBy("cohort_role").mode("errorifexists").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_registry(registry: DataFrame, path: str, version: str, provenance: str) -> None:
    """Sorted registry rows with their version and origin."""
    registry.withColumns({"version": F.lit(version), "provenance": F.lit(provenance)}).sort("domain").write.mode("errorifexists").json(path)
