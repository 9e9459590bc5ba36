"""Streams against their batch twins, with rows split over several files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from msgrisk.operators import evaluate, history
from msgrisk.streaming import operators as st

START = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, rows, schema, files=3):
    """A file stream that delivers ``rows`` in ``files`` chunks, in the given order."""
    folder = str(tmp_path / "in")
    step = -(-len(rows) // files)
    for i in range(files):
        chunk = rows[i * step:(i + 1) * step]
        if chunk:
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, tmp_path, df, mode="append"):
    name = f"out_{random.randint(0, 10**9)}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_sender_history_matches_batch(spark, tmp_path):
    random.seed(1)
    gaps = [random.choice([1, 3599, 3600, 3601, 20]) for _ in range(60)]
    at, rows = START, []
    for i, g in enumerate(gaps):
        at += dt.timedelta(seconds=g)
        rows.append((f"user{i % 2}@x.example", at))
    out = drain(spark, tmp_path, st.stream_sender_history(feed(spark, tmp_path, rows, "address string, ts timestamp"), b"k", 3600)).collect()
    batch = spark.createDataFrame(rows, "address string, ts timestamp")
    want = history.observation_episodes(batch, "address", "ts", 3600).collect()
    assert len(out) == 60
    assert sum(r.status == "first_seen" for r in out) == len(want)
    last = {}
    for r in out:
        last[(r.identity, r.first_seen)] = max(last.get((r.identity, r.first_seen), 0), r.seen_count)
    assert sorted(last.values()) == sorted(r.seen_count for r in want)


@pytest.mark.parametrize("anchored", [False, True])
def test_limiters(spark, tmp_path, anchored):
    random.seed(2)
    at, rows = 0, []
    for i in range(40):
        at += random.choice([1, 5, 30, 60])
        rows.append((f"k{i % 2}", START + dt.timedelta(seconds=at), i))
    make = st.stream_anchored_limiter if anchored else st.stream_sliding_limiter
    out = {r.event_id: r.allowed for r in drain(spark, tmp_path, make(feed(spark, tmp_path, rows, "key string, ts timestamp, event_id long"), 60, 2)).collect()}
    want, logs, opened = {}, {}, {}
    for key, ts, i in rows:
        t = (ts - START).total_seconds()
        if anchored:
            if key not in opened or t - opened[key][0] >= 60:
                opened[key] = [t, 0]
            opened[key][1] += 1
            want[i] = opened[key][1] <= 2
        else:
            live = [x for x in logs.get(key, []) if x > t - 60]
            want[i] = len(live) < 2
            logs[key] = live + [t] * want[i]
    assert out == want


def test_quota_ledger(spark, tmp_path):
    h = lambda hours: START + dt.timedelta(hours=hours)
    rows = [("s", "a", h(1), "reserve"), ("s", "a", h(2), "reserve"), ("s", "b", h(3), "reserve"), ("s", "c", h(4), "reserve"), ("s", "a", h(5), "finish"),
            ("s", "a", h(6), "reserve"), ("s", "b", h(7), "release"), ("s", "c", h(8), "reserve"), ("s", "a", h(9), "release"), ("s", "d", h(26), "reserve")]
    df = feed(spark, tmp_path, rows, "scope string, request_id string, ts timestamp, op string", files=2)
    out = sorted(drain(spark, tmp_path, st.stream_quota_ledger(df, 2)).collect(), key=lambda r: r.ts)
    assert [r.status for r in out] == ["reserved", "pending", "reserved", "quota_exhausted", "saved", "cached", "released", "reserved", "lost", "reserved"]
    assert out[-1].used == 1


def test_dedup_and_windows(spark, tmp_path):
    rows = [("x", START), ("x", START + dt.timedelta(minutes=1)), ("y", START + dt.timedelta(minutes=1)), ("x", START + dt.timedelta(minutes=2)), ("z", START + dt.timedelta(hours=9))]
    df = feed(spark, tmp_path, rows, "digest string, ts timestamp", files=5)
    assert sorted(r.digest for r in drain(spark, tmp_path, st.stream_dedup(df, "digest", "ts", "1 hour")).collect()) == ["x", "y", "z"]
    (tmp_path / "w").mkdir()
    df = feed(spark, tmp_path / "w", rows, "digest string, ts timestamp", files=1)
    out = drain(spark, tmp_path / "w", st.stream_windows(df, "ts", ["digest"], "1 hour"), "complete")
    want = history.window_report(spark.createDataFrame(rows, "digest string, ts timestamp"), "ts", ["digest"], "1 hour")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_evaluation_and_case_state(spark, tmp_path):
    random.seed(4)
    rows = [(random.choice(["phishing", "legitimate"]), random.choice(["alerted", "not_alerted", "undetermined"]), True, False, random.choice(["en", "de"])) for _ in range(50)]
    schema = "label string, decision string, complete boolean, ml_available boolean, language string"
    out = drain(spark, tmp_path, st.stream_evaluation(feed(spark, tmp_path, rows, schema), ["language"]), "complete")
    want = evaluate.with_rates(evaluate.evaluation_counts(spark.createDataFrame(rows, schema), ["language"]))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    (tmp_path / "c").mkdir()
    events = [(1, 1, "pending", None), (1, 2, "closed", "phishing"), (2, 1, "pending", None), (1, 3, "in_progress", None)]
    df = feed(spark, tmp_path / "c", events, "case_id int, seq int, status string, verdict string")
    got = drain(spark, tmp_path / "c", st.stream_case_state(df, "case_id", "seq", ["status", "verdict"]), "complete")
    assert sorted(map(tuple, got.collect())) == [(1, "in_progress", "phishing", 3), (2, "pending", None, 1)]


def test_score_stream(spark, tmp_path):
    df = feed(spark, tmp_path, [(i, "x" * i) for i in range(6)], "id int, text string", files=2)
    q = st.score_stream(df, lambda b: b.select("id", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(i, i) for i in range(6)]


def test_quota_ledger_late_rows(spark, tmp_path):
    h = lambda hours: START + dt.timedelta(hours=hours)
    rows = [("s", "a", h(25), "reserve"), ("s", "b", h(26), "reserve"), ("s", "late", h(1), "reserve"), ("s", "c", h(27), "reserve"), ("s", "x", h(200), "reserve"), ("s", "old", h(2), "reserve")]
    df = feed(spark, tmp_path, rows, "scope string, request_id string, ts timestamp, op string", files=6)
    out = {r.request_id: (r.status, r.used) for r in drain(spark, tmp_path, st.stream_quota_ledger(df, 2)).collect()}
    assert out["late"] == ("reserved", 1) and out["c"] == ("quota_exhausted", 2)
    assert out["x"] == ("reserved", 1) and out["old"] == ("too_late", 0)
