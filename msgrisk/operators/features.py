"""Profiles of tabular feature sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_profile(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("_total")).alias("share"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per feature and value, one scan for all features."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.feature", "p.value").agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("nulls")) for c in columns])).alias("p")).select("p.*")


def _long(one_row: DataFrame, names: list[tuple], out: list[str]) -> DataFrame:
    cells = [
        F.struct(*[F.lit(v).alias(n) for v, n in zip(labels, out)], F.col(column).alias("r")) for column, *labels in names
    ]
    return one_row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair in one aggregation; missing columns are skipped."""
    present = [c for c in columns if c in df.columns]
    pairs = [(f"r{i}_{j}", a, b) for i, a in enumerate(present) for j, b in enumerate(present) if i <= j]
    one = df.agg(*[F.corr(a, b).alias(n) for n, a, b in pairs])
    return _long(one, pairs, ["feature_a", "feature_b"])


def target_correlation(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Absolute correlation of each feature with the target."""
    present = [c for c in columns if c in df.columns]
    one = df.agg(*[F.abs(F.corr(c, target)).alias(f"r{i}") for i, c in enumerate(present)])
    return _long(one, [(f"r{i}", c) for i, c in enumerate(present)], ["feature"])


def group_mean_correlation(df: DataFrame, groups: dict[str, str], target: str) -> DataFrame:
    """Mean absolute target correlation per feature group."""
    r = target_correlation(df, list(groups), target)
    name = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return r.groupBy(F.element_at(name, F.col("feature")).alias("grp")).agg(
        F.avg("r").alias("mean_r"), F.count("r").alias("features")
    )


def top_correlated(df: DataFrame, columns: list[str], target: str, k: int) -> DataFrame:
    return target_correlation(df, columns, target).orderBy(F.desc("r"), "feature").limit(k)
