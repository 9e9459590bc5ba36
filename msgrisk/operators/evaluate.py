"""Evaluation reports over outcome tables and the no-regression gate."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.functions.stats import ratio, wilson_high, wilson_low

COUNTS = [
    "n", "phishing_count", "legitimate_count",
    "phishing_alerted", "phishing_not_alerted", "phishing_undetermined",
    "legitimate_alerted", "legitimate_not_alerted", "legitimate_undetermined",
    "unknown_count", "complete_count", "ml_available_count",
]
RATES = {
    "phishing_alert_recall": ("phishing_alerted", "phishing_count"),
    "legitimate_false_alert_rate": ("legitimate_alerted", "legitimate_count"),
    "unknown_rate": ("unknown_count", "n"),
    "complete_rate": ("complete_count", "n"),
    "ml_available_rate": ("ml_available_count", "n"),
}
# +1: may not fall, -1: may not rise.
DIRECTIONS = {
    "phishing_alerted": 1, "legitimate_alerted": -1, "phishing_undetermined": -1, "legitimate_undetermined": -1,
    "unknown_count": -1, "complete_count": 1, "ml_available_count": 1,
}


def count_columns() -> list[Column]:
    label, decision = F.col("label"), F.col("decision")
    cells = [
        F.count_if((label == who) & (decision == what)).alias(f"{who}_{what}")
        for who in ("phishing", "legitimate")
        for what in ("alerted", "not_alerted", "undetermined")
    ]
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(label == "phishing").alias("phishing_count"),
        F.count_if(label == "legitimate").alias("legitimate_count"),
        *cells,
        F.count_if(decision == "undetermined").alias("unknown_count"),
        F.count_if(F.col("complete")).alias("complete_count"),
        F.count_if(F.col("ml_available")).alias("ml_available_count"),
    ]


def with_rates(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Rates with their 95 % Wilson bounds; unknown cases stay in every denominator."""
    extra = []
    for name, (part, whole) in RATES.items():
        extra += [
            F.round(ratio(part, whole), digits).alias(name),
            F.round(wilson_low(part, whole), digits).alias(f"{name}_low"),
            F.round(wilson_high(part, whole), digits).alias(f"{name}_high"),
        ]
    return counts.select("*", *extra)


def evaluation_counts(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return outcomes.groupBy(*(by or [])).agg(*count_columns())


def evaluation_cube(outcomes: DataFrame, dims: list[str]) -> DataFrame:
    """Overall and every combination of the dimensions, one row per group.

    The rows are counted per finest cell first, so only those few rows are expanded.
    ``dim_set`` names the grouping, which keeps a null key apart from a subtotal.
    """
    finest = outcomes.groupBy(*dims).agg(*count_columns())
    cube = finest.cube(*dims).agg(
        F.concat_ws(",", *[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims]).alias("dim_set"),
        *[F.sum(c).alias(c) for c in COUNTS],
    )
    return with_rates(cube)


def evaluation_by(outcomes: DataFrame, dims: list[str]) -> DataFrame:
    """The single-dimension groupings in long form."""
    finest = outcomes.groupBy(*dims).agg(*count_columns())
    long = finest.select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("g"),
        *COUNTS,
    )
    return with_rates(long.groupBy("g.dim", "g.value").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def multiset_fingerprint(df: DataFrame, record: Column, tag: str) -> DataFrame:
    """Order-independent, multiplicity-sensitive digest of a table.

    Four 60-bit parts of every record's SHA-256 are summed, so partial sums combine map-side
    and no group of digests is ever gathered.
    """
    digest = F.sha2(record, 256)
    parts = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)
    ]
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    line = F.concat_ws("|", F.lit(tag), F.col("n_rows").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)])
    return sums.select("n_rows", F.sha2(line, 256).alias("fingerprint"))


def report_accounting_check(report: DataFrame, dims: list[str]) -> DataFrame:
    """Groups of a cube report whose counts do not follow from its finest cells."""
    finest = report.where(F.col("dim_set") == ",".join(dims))
    again = finest.cube(*dims).agg(
        F.concat_ws(",", *[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims]).alias("dim_set"),
        *[F.sum(c).alias(f"again_{c}") for c in COUNTS],
    )
    same_group = F.lit(True)
    for d in ["dim_set", *dims]:
        same_group = same_group & F.col(f"r.{d}").eqNullSafe(F.col(f"a.{d}"))
    joined = report.alias("r").join(again.alias("a"), same_group, "full")
    differs = F.lit(False)
    for c in COUNTS:
        differs = differs | ~F.col(f"r.{c}").eqNullSafe(F.col(f"a.again_{c}"))
    inner = (F.col("r.n") != F.col("r.phishing_count") + F.col("r.legitimate_count")) | (
        F.col("r.unknown_count") != F.col("r.phishing_undetermined") + F.col("r.legitimate_undetermined")
    )
    return joined.where(differs | inner).select(
        F.coalesce("r.dim_set", "a.dim_set").alias("dim_set"),
        *[F.coalesce(f"r.{d}", f"a.{d}").alias(d) for d in dims],
    )


def compare_reports(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and metric: both counts, their difference, and what is wrong with it.

    A group missing on one side or counted over another denominator is incomparable, never
    silently skipped.
    """
    same_group = F.lit(True)
    for k in keys:
        same_group = same_group & F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
    joined = baseline.alias("b").join(candidate.alias("c"), same_group, "full")
    missing = F.col("b.n").isNull() | F.col("c.n").isNull()
    denominators = F.lit(False)
    for c in ("n", "phishing_count", "legitimate_count"):
        denominators = denominators | ~F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}"))
    metrics = F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.col(f"b.{m}").alias("baseline"), F.col(f"c.{m}").alias("candidate"),
            F.lit(direction).alias("direction"),
        )
        for m, direction in DIRECTIONS.items()
    ])
    long = joined.select(
        *[F.coalesce(f"b.{k}", f"c.{k}").alias(k) for k in keys],
        F.when(missing, "missing_group").when(denominators, "incomparable_denominator").alias("problem"),
        F.explode(metrics).alias("m"),
    )
    delta = F.col("m.candidate") - F.col("m.baseline")
    return long.select(
        *keys, "m.metric", "m.baseline", "m.candidate", delta.alias("delta"),
        F.coalesce("problem", F.when(delta * F.col("m.direction") < 0, "regression"), F.lit("ok")).alias("status"),
    )


def regression_gate(comparison: DataFrame, baseline_config: dict | None = None, candidate_config: dict | None = None) -> DataFrame:
    """One row: pass flag and how many findings of each kind block it.

    The gate fails closed: without configurations that agree, or with nothing compared, it does not pass.
    """
    configured = baseline_config is not None and baseline_config == candidate_config
    return comparison.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("status") == "regression").alias("regressions"),
        F.count_if(F.col("status").isin("missing_group", "incomparable_denominator")).alias("incomparable"),
    ).withColumn("passed", (F.col("checked") > 0) & (F.col("regressions") == 0) & (F.col("incomparable") == 0) & F.lit(configured))


def shadow_aggregate(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Baseline, auxiliary and OR-combined decisions side by side.

    Input: ``label, baseline, auxiliary, shadow, probability, status``.
    """
    phishing, legitimate = F.col("label") == "phishing", F.col("label") == "legitimate"
    new_alert = (F.col("baseline") != "alerted") & (F.col("shadow") == "alerted")
    per_view = [
        F.count_if(who & (F.col(view) == "alerted")).alias(f"{view}_{name}_alerted")
        for view in ("baseline", "auxiliary", "shadow")
        for who, name in ((phishing, "phishing"), (legitimate, "legitimate"))
    ]
    return outcomes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(phishing).alias("phishing_count"),
        F.count_if(legitimate).alias("legitimate_count"),
        *per_view,
        F.count_if(phishing & new_alert).alias("recovered_phishing"),
        F.count_if(legitimate & new_alert).alias("new_legitimate_alerts"),
        F.count("probability").alias("brier_n"),
        F.avg(F.pow(F.col("probability") - phishing.cast("double"), 2)).alias("brier_score"),
        F.count_if(F.col("status") == "available").alias("available"),
    )


def auxiliary_decision(probability: Column, insufficient: Column, incomplete: Column, threshold: float) -> Column:
    """Null evidence, weak evidence or incomplete input never decides."""
    undecided = probability.isNull() | (insufficient >= 0.5) | incomplete
    return F.when(F.coalesce(undecided, F.lit(True)), "undetermined").when(probability >= threshold, "alerted").otherwise(
        "not_alerted"
    )


def or_decision(baseline: Column, auxiliary: Column) -> Column:
    """Auxiliary evidence may add an alert; it never clears one."""
    return F.when((baseline == "alerted") | (auxiliary == "alerted"), "alerted").otherwise(baseline)


def usage_totals(calls: DataFrame) -> DataFrame:
    """Token totals over well-formed calls, with the distinct models and question sets."""
    valid = (F.col("input_tokens") >= 0) & (F.col("output_tokens") >= 0)
    return calls.agg(
        F.count_if(valid).alias("reported_calls"),
        F.sum(F.when(valid, F.col("input_tokens"))).alias("input_tokens"),
        F.sum(F.when(valid, F.col("output_tokens"))).alias("output_tokens"),
        F.count_distinct("model").alias("models"),
        F.count_distinct("questions_sha256").alias("question_sets"),
    )


def all_dim_sets(dims: list[str]) -> list[str]:
    return [",".join(c) for k in range(len(dims) + 1) for c in combinations(dims, k)]
