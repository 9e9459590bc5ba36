"""Event history: sender episodes, rates, quotas, review transitions.

All operators are keyed by a sender, scope or case that may be very active; each works on
time slices of a key first, so one key never has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgrisk.operators.scale import ordered_within_key, range_bucket, range_cuts


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _slice(micros: Column, width: int) -> Column:
    """Number of the aligned slice, in exact integer arithmetic."""
    return ((micros - F.pmod(micros, F.lit(width))) / F.lit(width)).cast("bigint")


def observation_episodes(events: DataFrame, identity: str, ts: str, ttl_seconds: int) -> DataFrame:
    """Sliding-expiry history: a gap of at least the time to live starts a new episode.

    Two events of one aligned slice of that width are always closer than the limit, so slices
    are summed map-side and only slice summaries (at most one per key and slice) are chained.
    """
    ttl = ttl_seconds * 1_000_000
    slices = events.groupBy(identity, _slice(_micros(ts), ttl).alias("_slice")).agg(
        F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    chain = Window.partitionBy(identity).orderBy("_slice")
    gap = _micros("lo") - F.lag(_micros("hi")).over(chain)
    marked = slices.withColumn("_break", F.coalesce((gap >= ttl).cast("int"), F.lit(0)))
    numbered = marked.withColumn("episode", F.sum("_break").over(chain.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return numbered.groupBy(identity, "episode").agg(
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
        F.sum("n").alias("seen_count"),
    ).withColumn("status", F.when(F.col("seen_count") > 1, "previously_seen").otherwise("first_seen"))


def sliding_rate(events: DataFrame, key: str, ts: str, window_seconds: int, limit: int, windows_per_slice: int = 4) -> DataFrame:
    """Hits of the key in the trailing window ``(t - w, t]``, per event.

    Events are cut into slices a few windows wide; the last window of a slice is repeated as
    context for the next one, so every slice is counted on its own.
    """
    width = window_seconds * 1_000_000
    span = width * windows_per_slice
    micros = _micros(ts)
    at = _slice(micros, span)
    homes = F.when(
        F.pmod(micros, F.lit(span)) > F.lit(span - width),
        F.array(F.struct(at.alias("s"), F.lit(True).alias("own")), F.struct((at + 1).alias("s"), F.lit(False).alias("own"))),
    ).otherwise(F.array(F.struct(at.alias("s"), F.lit(True).alias("own"))))
    spread = events.withColumn("_t", micros).withColumn("_home", F.explode(homes))
    spread = spread.select("*", F.col("_home.s").alias("_slice"), F.col("_home.own").alias("_own")).drop("_home")
    trailing = Window.partitionBy(key, "_slice").orderBy("_t").rangeBetween(-(width - 1), 0)
    counted = spread.withColumn("hits", F.count(F.lit(1)).over(trailing)).where("_own")
    return counted.withColumn("over_limit", F.col("hits") > limit).drop("_t", "_slice", "_own")


def quota_rank(attempts: DataFrame, scope: str, ts: str, order: list[str], daily_limit: int, slice_seconds: int = 600) -> DataFrame:
    """Position of every attempt in its scope and UTC day, and whether the budget is spent."""
    keyed = attempts.withColumn("day", F.to_date(ts)).withColumn(
        "_bucket", _slice(_micros(ts), slice_seconds * 1_000_000)
    )
    ranked = ordered_within_key(keyed, [scope, "day"], order, "_bucket", position="attempt").drop("_bucket")
    return ranked.withColumn("status", F.when(F.col("attempt") > daily_limit, "quota_exhausted").otherwise("reserved"))


# Which review status may follow which.
TRANSITIONS = {"pending": ["pending", "in_progress"], "in_progress": ["in_progress", "closed"], "closed": ["in_progress"]}


def status_transitions(
    events: DataFrame, case: str, order: str, status: str, allowed: dict[str, list[str]] = TRANSITIONS, start: str = "pending"
) -> DataFrame:
    """Check each status against its predecessor; the version is the event's position."""
    bucketed = range_bucket(events, order, range_cuts(events, order))
    linked = ordered_within_key(bucketed, [case], [order], "_bucket", position="version", previous={status: "previous"})
    before = F.when(F.col("version") == 1, F.lit(start)).otherwise(F.col("previous"))
    pairs = [F.lit(f"{a}>{b}") for a, targets in allowed.items() for b in targets]
    legal = F.concat_ws(">", before, F.col(status)).isin(*pairs)
    return linked.withColumn("previous", before).withColumn("allowed", legal).withColumn(
        "action", F.when(before == "closed", "reopened").otherwise("reviewed")
    ).drop("_bucket")


def latest_field_change(events: DataFrame, case: str, order: str, value: str, changed: Column) -> DataFrame:
    """Value set by the last event that explicitly changed the field, including to null."""
    return events.where(changed).groupBy(case).agg(
        F.max_by(F.col(value), F.col(order)).alias("value"), F.max(order).alias("changed_at")
    )


def case_state(events: DataFrame, case: str, order: str, fields: list[str]) -> DataFrame:
    """Latest non-null value of every field and the number of events (version) per case."""
    latest = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return events.groupBy(case).agg(*latest, F.count(F.lit(1)).alias("version"))


def window_report(events: DataFrame, ts: str, by: list[str], width: str, slide: str | None = None,
                  value: str | None = None) -> DataFrame:
    """Tumbling (or sliding) counts, usable on a stream and on a table."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    measures = [F.count(F.lit(1)).alias("n")]
    if value:
        measures.append(F.sum(value).alias("total"))
    out = events.groupBy(window.alias("w"), *by).agg(*measures)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
                      "n", *(["total"] if value else []))


# --- capacity ------------------------------------------------------------------------

# Slots and bytes kept free per review status.
SLOT_RESERVE = {"pending": 2, "in_progress": 1, "closed": 0}
SLOT_LIMIT, RECORD_BYTES, BYTE_RESERVE = 200, 750_000, 50_000


def capacity_report(cases: DataFrame, n_events: Column, record_bytes: Column, status: str = "status") -> DataFrame:
    """History slots and bytes used and left under the reserve of the case's status."""
    reserve = F.element_at(F.create_map(*[F.lit(x) for p in SLOT_RESERVE.items() for x in p]), F.col(status))
    bytes_left = F.lit(RECORD_BYTES) - reserve * BYTE_RESERVE - record_bytes
    slots_left = F.lit(SLOT_LIMIT) - n_events - reserve
    return cases.select(
        "*",
        n_events.alias("used"),
        F.greatest(slots_left, F.lit(0)).cast("bigint").alias("remaining"),
        record_bytes.cast("bigint").alias("bytes_used"),
        F.greatest(bytes_left, F.lit(0)).cast("bigint").alias("bytes_remaining"),
        ((n_events + 1 + reserve <= SLOT_LIMIT) & (bytes_left > 0)).alias("write_allowed"),
    )


# --- limits and ledgers on tables (batch twins of the streaming operators) -----------


def idempotency_check(requests: DataFrame, keys: list[str], digest: str, order: str) -> DataFrame:
    """Per (actor, key): the first digest, how often it was replayed, how often it differed.

    Requests are first counted per distinct digest, which collapses replays map-side.
    """
    per_digest = requests.groupBy(*keys, digest).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at"))
    per_key = per_digest.groupBy(*keys).agg(
        F.min_by(F.struct(digest, "n"), F.col("first_at")).alias("first"), F.sum("n").alias("requests")
    )
    return per_key.select(
        *keys,
        F.col(f"first.{digest}").alias("accepted"),
        "requests",
        (F.col("first.n") - 1).alias("replays"),
        (F.col("requests") - F.col("first.n")).alias("conflicts"),
    )
