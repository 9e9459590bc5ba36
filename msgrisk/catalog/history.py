"""Histories, rates and quotas over the events table; a user stands in for a sender or case."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.registry import query, table
from msgrisk.functions.hashing import canonical_sender, hmac_sha256
from msgrisk.operators import history as ops

# A public demonstration key; production callers pass their own secret.
_KEY = b"demo-key"


def address(user="user_id"):
    """A mailbox per user, with the plus tags and dots that aliases add."""
    u = F.col(user).cast("string")
    return F.when(F.col("event_type") == "click", F.concat(F.lit("User."), u, F.lit("+news@gmail.com"))).otherwise(
        F.concat(F.lit("user"), u, F.lit("@gmail.com"))
    )


@query("sender_episodes", """
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
b AS (SELECT user_id, ts, sum(CASE WHEN prev IS NOT NULL AND epoch_us(ts) - epoch_us(prev) >= 86400000000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) + 1 AS episode FROM e)
SELECT user_id, episode::BIGINT AS episode, min(ts) AS first_seen, max(ts) AS last_seen, count(*)::BIGINT AS seen_count,
  CASE WHEN count(*) > 1 THEN 'previously_seen' ELSE 'first_seen' END AS status FROM b GROUP BY user_id, episode""")
def sender_episodes(spark, d):
    return ops.observation_episodes(table(spark, d, "events"), "user_id", "ts", 86_400)


def _sql_hmac(x):
    import hashlib
    key = _KEY.ljust(64, b"\0")
    esc = lambda bs: "".join(f"\\x{b:02X}" for b in bs)
    inner = esc(b ^ 0x36 for b in key)
    outer = esc(b ^ 0x5C for b in key)
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({x}))))"


@query("keyed_sender_identities", f"""
WITH a AS (SELECT 'user' || user_id || '@gmail.com' AS who, ts FROM events)
SELECT {_sql_hmac('who')} AS identity, count(*)::BIGINT AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM a GROUP BY who""")
def keyed_sender_identities(spark, d):
    """Aliases fold to one keyed pseudonym; no raw address leaves the projection."""
    keyed = table(spark, d, "events").select(hmac_sha256(_KEY, canonical_sender(address())).alias("identity"), "ts")
    return keyed.groupBy("identity").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("sliding_rate", """
SELECT event_id, user_id, (count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW))::BIGINT AS hits,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) > 3 AS over_limit FROM events""")
def sliding_rate(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return ops.sliding_rate(events, "user_id", "ts", 6 * 3600, 3).drop("ts")


@query("daily_quota", """
WITH r AS (SELECT event_id, user_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS attempt FROM events)
SELECT event_id, user_id, day, attempt::BIGINT AS attempt, CASE WHEN attempt > 5 THEN 'quota_exhausted' ELSE 'reserved' END AS status FROM r""")
def daily_quota(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    out = ops.quota_rank(events, "user_id", "ts", ["ts", "event_id"], 5)
    return out.select("event_id", "user_id", "day", F.col("attempt").cast("bigint").alias("attempt"), "status")


# Event types read as review statuses.
_STATUS = {"view": "pending", "click": "in_progress", "purchase": "closed", "signup": "in_progress", "error": "pending"}
_SQL_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"


def review_events(spark, d):
    status = F.element_at(F.create_map(*[F.lit(x) for p in _STATUS.items() for x in p]), F.col("event_type"))
    return table(spark, d, "events").select("event_id", "user_id", status.alias("status"))


@query("event_transitions", f"""
WITH e AS (SELECT event_id, user_id, {_SQL_STATUS} AS status FROM events),
l AS (SELECT *, coalesce(lag(status) OVER w, 'pending') AS previous, row_number() OVER w AS version FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, status, previous, version::BIGINT AS version,
  (previous || '>' || status) IN ('pending>pending', 'pending>in_progress', 'in_progress>in_progress', 'in_progress>closed', 'closed>in_progress') AS allowed,
  CASE WHEN previous = 'closed' THEN 'reopened' ELSE 'reviewed' END AS action FROM l""")
def event_transitions(spark, d):
    out = ops.status_transitions(review_events(spark, d), "user_id", "event_id", "status")
    return out.withColumn("version", F.col("version").cast("bigint"))


@query("latest_field_change", """
SELECT user_id, arg_max(struct_pack(v := CASE WHEN value >= 5 THEN json_extract_string(props, '$.k') END), event_id).v AS value, max(event_id) AS changed_at
FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id""")
def latest_field_change(spark, d):
    """Clicks and errors change the field; a low value clears it."""
    events = table(spark, d, "events").withColumn("to", F.when(F.col("value") >= 5, F.get_json_object("props", "$.k")))
    return ops.latest_field_change(events, "user_id", "event_id", "to", F.col("event_type").isin("click", "error"))


@query("case_state", f"""
WITH e AS (SELECT event_id, user_id, {_SQL_STATUS} AS status, CASE WHEN value >= 8 THEN event_type END AS verdict FROM events)
SELECT user_id, arg_max(status, event_id) AS status, arg_max(verdict, event_id) FILTER (WHERE verdict IS NOT NULL) AS verdict,
  count(*)::BIGINT AS version FROM e GROUP BY user_id""")
def case_state(spark, d):
    events = review_events(spark, d).join(
        table(spark, d, "events").select("event_id", F.when(F.col("value") >= 8, F.col("event_type")).alias("verdict")), "event_id")
    return ops.case_state(events, "user_id", "event_id", ["status", "verdict"])


@query("minute_windows", """
SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' AS window_end,
  event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def minute_windows(spark, d):
    out = ops.window_report(table(spark, d, "events"), "ts", ["event_type"], "1 minute", value="value")
    return out.withColumn("total", F.round("total", 4))


@query("sliding_windows", """
SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, event_type, count(*)::BIGINT AS n
FROM (SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * i) AS window_start FROM events, range(4) t(i)) GROUP BY 1, 2, 3""")
def sliding_windows(spark, d):
    return ops.window_report(table(spark, d, "events"), "ts", ["event_type"], "1 hour", "15 minutes")


@query("capacity_report", f"""
WITH c AS (SELECT user_id, arg_max({_SQL_STATUS}, event_id) AS status, count(*) AS n, sum(octet_length(encode(props))) AS b FROM events GROUP BY user_id),
r AS (SELECT *, CASE status WHEN 'pending' THEN 2 WHEN 'in_progress' THEN 1 ELSE 0 END AS reserve FROM c)
SELECT user_id, status, n::BIGINT AS used, greatest(200 - n - reserve, 0)::BIGINT AS remaining, b::BIGINT AS bytes_used,
  greatest(750000 - reserve * 50000 - b, 0)::BIGINT AS bytes_remaining, (n + 1 + reserve <= 200) AND (750000 - reserve * 50000 - b > 0) AS write_allowed FROM r""")
def capacity_report(spark, d):
    events = review_events(spark, d).join(table(spark, d, "events").select("event_id", "props"), "event_id")
    cases = events.groupBy("user_id").agg(
        F.max_by("status", "event_id").alias("status"), F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("props")).alias("_b"))
    return ops.capacity_report(cases, F.col("_n"), F.col("_b")).drop("_n", "_b")


@query("idempotency_check", """
WITH r AS (SELECT user_id, json_extract_string(props, '$.k') AS request_key, event_type AS digest, event_id FROM events),
f AS (SELECT user_id, request_key, arg_min(digest, event_id) AS accepted FROM r GROUP BY 1, 2)
SELECT user_id, request_key, accepted, count(*)::BIGINT AS requests, (count(*) FILTER (WHERE digest = accepted) - 1)::BIGINT AS replays,
  count(*) FILTER (WHERE digest <> accepted)::BIGINT AS conflicts FROM r JOIN f USING (user_id, request_key) GROUP BY 1, 2, 3""")
def idempotency_check(spark, d):
    requests = table(spark, d, "events").select(
        "user_id", F.get_json_object("props", "$.k").alias("request_key"), F.col("event_type").alias("digest"), "event_id")
    return ops.idempotency_check(requests, ["user_id", "request_key"], "digest", "event_id")
