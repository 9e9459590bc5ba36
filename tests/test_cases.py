"""Versioned review writes: rules, batch against stream in another order."""

import datetime as dt
import random

from pyspark.sql import functions as F
from test_streaming import drain, feed

from msgrisk.operators.cases import case_attempts, refused, settle
from msgrisk.streaming.cases import stream_case_attempts

START = dt.datetime(2024, 1, 1)
SCHEMA = "case_id string, ts timestamp, seq long, expected_version long, status string, verdict string"


def test_rules():
    new = (0, "pending", None)
    assert settle(new, 0, "in_progress", None) == ((1, "in_progress", None), "applied")
    assert settle(new, 1, "in_progress", None) == (new, "conflict") and settle(new, None, "in_progress", None) == (new, "conflict")
    assert settle(new, 0, "closed", "phishing")[1] == "invalid_transition" and settle(new, 0, None, None)[1] == "invalid_transition"
    assert settle((3, "in_progress", None), 3, "closed", None)[1] == "verdict_required" and settle(new, 0, "pending", None)[1] == "unchanged"
    assert settle((3, "closed", "phishing"), 3, "in_progress", "phishing") == ((4, "in_progress", "phishing"), "applied")


def writes(seed=3, n=90):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        out.append((f"c{draw.randrange(4)}", START + dt.timedelta(minutes=i // 2), i, draw.choice([0, 0, 1, 1, 2, 3, None]),
                    draw.choice(["pending", "in_progress", "closed", "closed"]), draw.choice([None, "phishing", "legitimate"])))
    return out


def by_hand(rows):
    cases, out = {}, {}
    for case, ts, seq, expected, status, verdict in sorted(rows, key=lambda r: (r[1], r[2])):
        cases[case], outcome = settle(cases.get(case, (0, "pending", None)), expected, status, verdict)
        out[seq] = (outcome, *cases[case])
    return out


def test_batch(spark):
    rows = writes()
    table = spark.createDataFrame([*rows, (None, START, 900, 0, "closed", None)], SCHEMA).repartition(3)
    got = {r.seq: (r.outcome, r.case_version, r.case_status, r.case_verdict) for r in case_attempts(table).collect()}
    assert got.pop(900) == ("invalid_case", None, None, None)
    assert got == by_hand(rows) and len({o for o, *_ in got.values()}) == 5
    assert refused(case_attempts(table)).count() == 1 + sum(o != "applied" for o, *_ in got.values())
    assert case_attempts(table.limit(0)).count() == 0


def test_stream_out_of_order_equals_batch(spark, tmp_path):
    rows = writes()
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    # One file of rows that move the watermark past all others, then one of rows that come too late to count.
    end = [("end", START + dt.timedelta(days=2, minutes=i), 1000 + i, 0, "pending", None) for i in range(30)]
    late = [("c1", START - dt.timedelta(days=5, hours=i), 2000 + i, 0, "in_progress", None) for i in range(29)] + [("end", START + dt.timedelta(days=4), 3000, 0, "pending", None)]
    stream = stream_case_attempts(feed(spark, tmp_path, mixed + end + late, SCHEMA, files=5), "1 day")
    got = {r.seq: (r.outcome, r.case_version, r.case_status, r.case_verdict) for r in drain(spark, tmp_path, stream).where(F.col("seq") < 1000).collect()}
    assert got == by_hand(rows)
