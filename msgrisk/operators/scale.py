"""Building blocks that keep joins and windows safe under heavy keys.

* ``salted_join`` spreads the few keys that dominate one side over several tasks;
* ``ordered_within_key`` numbers and links rows of a key without one task per key;
* ``range_bucket`` cuts a value range into pieces of similar size;
* ``small_or_none`` proves a size bound before a table is broadcast.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 20_000
HOT_ROWS = 100_000
NULL_SALTS = 4096


def hot_keys(df: DataFrame, keys: list[str], max_keys: int = HOT_KEYS, min_rows: int = HOT_ROWS) -> DataFrame:
    """The heaviest keys, at most ``max_keys``, with one salt for every ``min_rows`` of their rows.

    A key left out has fewer than ``min_rows`` rows or less than one row in ``max_keys``; the result is
    always small enough to broadcast.
    """
    present = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    counts = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows)
    return counts.orderBy(F.desc("_rows"), *keys).limit(max_keys).select(*keys, F.ceil(F.col("_rows") / F.lit(min_rows)).cast("int").alias("_salts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    spread_by: list[str],
    **hot,
) -> DataFrame:
    """Join a possibly skewed ``left`` to a ``right`` that is unique per key.

    Heavy keys (and null keys, which never match) of the left side are spread by a hash of
    ``spread_by`` over as many salts as their rows ask for; only the right rows of heavy keys
    are repeated per salt.
    """
    heavy = hot_keys(left.select(*keys), keys, **hot)
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    salts = F.when(no_key, F.lit(NULL_SALTS)).otherwise(F.coalesce(F.col("_salts"), F.lit(1)))
    salted_left = left.join(F.broadcast(heavy), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")
    ).drop("_salts")
    salted_right = right.join(F.broadcast(heavy), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Split an under-split input over the cores before CPU-heavy row work.

    A scan that already has at least one partition per core is returned unchanged, so large
    inputs are never shuffled for this. Hashing by key keeps retries deterministic.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def small_or_none(df: DataFrame, max_rows: int = 200_000) -> DataFrame | None:
    """``df`` marked for broadcast if it provably has at most ``max_rows`` rows, else None."""
    if df.limit(max_rows + 1).count() > max_rows:
        return None
    return F.broadcast(df)


def dimension_join(left: DataFrame, dim: DataFrame, keys: list[str], how: str, spread_by: list[str],
                   max_rows: int = 200_000) -> DataFrame:
    """Broadcast a dimension whose size was checked; salt the join beyond that size."""
    small = small_or_none(dim, max_rows)
    if small is not None:
        return left.join(small, keys, how)
    return salted_join(left, dim, keys, how, spread_by)


def _as_number(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    return (c.cast("timestamp") if kind.startswith("timestamp") else c).cast("double")


def range_cuts(df: DataFrame, column: str, buckets: int = 256) -> list[float]:
    """Approximate quantiles of a column: a bounded list of cut points."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.select(F.percentile_approx(_as_number(df, column), shares, 10_000).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def range_bucket(df: DataFrame, column: str, cuts: list[float], output: str = "_bucket") -> DataFrame:
    """Monotone bucket number of a value; equal values share a bucket."""
    if not cuts:
        return df.withColumn(output, F.lit(0.0))
    cut = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="_value", outputCol=output, handleInvalid="keep"
    )
    return cut.transform(df.withColumn("_value", _as_number(df, column))).drop("_value")


def cumulate(
    df: DataFrame, value: str, measures: list[str], keys: list[str] | None = None, descending: bool = False
) -> DataFrame:
    """Running totals of measures over the distinct values of a column, per key.

    Values are grouped first, cut into ranges of similar size, and summed per range; the
    running total is then a short prefix over ranges plus a window inside each range, so no
    task sees a whole key. Adds ``cum_<m>`` (inclusive) and ``all_<m>`` per measure.
    """
    keys = keys or []
    cuts = range_cuts(df, value)
    grouped = df.groupBy(*keys, value).agg(*[F.sum(m).alias(m) for m in measures])
    grouped = range_bucket(grouped, value, cuts)
    direction = F.desc if descending else F.asc
    ranges = grouped.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    chain = Window.partitionBy(*keys).orderBy(direction("_bucket"))
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    ranges = ranges.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_b_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    if not keys:
        ranges = F.broadcast(ranges)  # at most one row per cut point
    inside = Window.partitionBy(*keys, "_bucket").orderBy(direction(value)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = grouped.join(ranges, [*keys, "_bucket"])
    return joined.select(
        *keys,
        value,
        *measures,
        *[(F.col(f"_b_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
    )


def ordered_within_key(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: str,
    position: str = "position",
    previous: dict[str, str] | None = None,
    running: dict[str, str] | None = None,
) -> DataFrame:
    """Number the rows of each key and look one row back, in two levels.

    ``bucket`` must grow with ``order``. Each (key, bucket) piece is ordered on its own; the
    pieces are then chained through one summary row per piece, so a key that holds a large
    share of the table is still split over many tasks. ``previous`` maps columns to the name
    of their predecessor's value, ``running`` maps columns to the name of their sum over all
    earlier rows of the key.
    """
    previous, running = previous or {}, running or {}
    piece = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = df.withColumn("_local", F.row_number().over(piece))
    for column, name in previous.items():
        local = local.withColumn(f"_lag_{name}", F.lag(column).over(piece))
    earlier = piece.rowsBetween(Window.unboundedPreceding, -1)
    for column, name in running.items():
        local = local.withColumn(f"_sum_{name}", F.coalesce(F.sum(column).over(earlier), F.lit(0)))
    carried = [F.max_by(F.col(c), F.struct(*order)).alias(f"_last_{n}") for c, n in previous.items()]
    pieces = df.groupBy(*keys, bucket).agg(
        F.count(F.lit(1)).alias("_n"), *carried, *[F.sum(c).alias(f"_t_{n}") for c, n in running.items()]
    )
    chain = Window.partitionBy(*keys).orderBy(bucket)
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *keys,
        bucket,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.lag(f"_last_{n}").over(chain).alias(f"_carry_{n}") for n in previous.values()],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in running.values()],
    )
    joined = local.join(pieces, [*keys, bucket])
    out = joined.withColumn(position, F.col("_before") + F.col("_local"))
    for name in previous.values():
        out = out.withColumn(
            name, F.when(F.col("_local") == 1, F.col(f"_carry_{name}")).otherwise(F.col(f"_lag_{name}"))
        )
    for name in running.values():
        out = out.withColumn(name, F.col(f"_base_{name}") + F.col(f"_sum_{name}"))
    helper = ["_local", "_before", *[f"_{k}_{n}" for n in running.values() for k in ("base", "sum")], *[f"_lag_{n}" for n in previous.values()], *[f"_carry_{n}" for n in previous.values()]]
    return out.drop(*helper)


def hash_bucket(hex_digest: Column, digits: int = 3) -> Column:
    """Leading hex digits: buckets that grow with the digest and are even in size."""
    return F.substring(hex_digest, 1, digits)
