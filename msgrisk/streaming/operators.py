"""Structured Streaming forms of the event operators.

State is kept per key with event-time timers; identities are pseudonymized before they reach
a state store. Each operator has a batch twin in ``operators.history`` or ``operators.evaluate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from msgrisk.functions.hashing import canonical_sender, hmac_sha256
from msgrisk.operators.evaluate import count_columns, with_rates
from msgrisk.operators.history import window_report

HISTORY = "identity string, status string, first_seen timestamp, last_seen timestamp, seen_count long"
DECISION = "key string, ts timestamp, event_id long, hits long, allowed boolean"
LEDGER = "scope string, request_id string, ts timestamp, op string, status string, used long"


def _micros(value) -> int:
    return int(pd.Timestamp(value).value // 1000)


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class _History(StatefulProcessor):
    """First, last and count per identity; a gap of the time to live starts over.

    Events of one batch are taken in time order, and later arrivals inside the live episode
    still extend it by minimum and maximum.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("episode", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(_micros(t) for batch in rows for t in batch["ts"])
        current = self.state.get() if self.state.exists() else None
        out = []
        for t in times:
            if current is None or t - current[1] >= self.ttl:
                current, status = (t, t, 1), "first_seen"
            else:
                current, status = (min(current[0], t), max(current[1], t), current[2] + 1), "previously_seen"
            out.append((key[0], status, _stamp(current[0]), _stamp(current[1]), current[2]))
        if current is not None:
            self.state.update(current)
            self.handle.registerTimer(current[1] // 1000 + self.ttl // 1000)
        yield pd.DataFrame(out, columns=["identity", "status", "first_seen", "last_seen", "seen_count"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and expiredTimerInfo.getExpiryTimeInMs() >= (self.state.get()[1] + self.ttl) // 1000:
            self.state.clear()
        yield pd.DataFrame(columns=["identity", "status", "first_seen", "last_seen", "seen_count"])

    def close(self) -> None:
        pass


def stream_sender_history(events: DataFrame, secret: bytes, ttl_seconds: int, delay: str = "1 hour") -> DataFrame:
    """One row per observation of ``events(address, ts)`` with the identity's history."""
    keyed = events.select(hmac_sha256(secret, canonical_sender("address")).alias("identity"), "ts").withWatermark("ts", delay)
    return keyed.groupBy("identity").transformWithStateInPandas(
        _History(ttl_seconds), HISTORY, outputMode="append", timeMode="EventTime")


class _Limiter(StatefulProcessor):
    """Sliding log (rejected hits leave no trace) or a window anchored at its first hit.

    A key is forgotten once the watermark is a window past its last hit.
    """

    def __init__(self, window_seconds: int, limit: int, anchored: bool):
        self.width, self.limit, self.anchored = window_seconds * 1_000_000, limit, anchored

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", "times array<long>, count long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((_micros(t), int(e)) for batch in rows for t, e in zip(batch["ts"], batch["event_id"]))
        times, count, last = (list(self.log.get()[0]), *self.log.get()[1:]) if self.log.exists() else ([], 0, 0)
        out = []
        for t, event_id in events:
            last = max(last, t)
            if self.anchored:
                if not times or t - times[0] >= self.width:
                    times, count = [t], 0
                count += 1
                allowed, hits = count <= self.limit, count
            else:
                times = [x for x in times if x > t - self.width]
                allowed = len(times) < self.limit
                if allowed:
                    times.append(t)
                hits = len(times)
            out.append((key[0], _stamp(t), event_id, hits, allowed))
        self.log.update((times, count, last))
        self.handle.registerTimer((last + self.width) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "ts", "event_id", "hits", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.log.exists() and expiredTimerInfo.getExpiryTimeInMs() * 1000 > self.log.get()[2] + self.width:
            self.log.clear()
        yield pd.DataFrame(columns=["key", "ts", "event_id", "hits", "allowed"])

    def close(self) -> None:
        pass


def _limiter(events: DataFrame, window_seconds: int, limit: int, anchored: bool, delay: str) -> DataFrame:
    return events.select("key", "ts", "event_id").withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(
        _Limiter(window_seconds, limit, anchored), DECISION, outputMode="append", timeMode="EventTime")


def stream_sliding_limiter(events: DataFrame, window_seconds: int, limit: int, delay: str = "1 hour") -> DataFrame:
    """``events(key, ts, event_id)`` allowed while fewer than ``limit`` accepted hits are in the window."""
    return _limiter(events, window_seconds, limit, anchored=False, delay=delay)


def stream_anchored_limiter(events: DataFrame, window_seconds: int, limit: int, delay: str = "1 hour") -> DataFrame:
    """The window opens at the first hit and closes a fixed time later."""
    return _limiter(events, window_seconds, limit, anchored=True, delay=delay)


class _Ledger(StatefulProcessor):
    """Budgets of a scope by calendar day, and receipts that live for 24 hours.

    A call is booked on the day of its own time, so late calls neither reset nor use up another day. Days and receipts
    that no call within the allowed lateness can touch are forgotten; a call behind that is answered ``too_late``.
    """

    DAY = 86_400_000_000

    def __init__(self, daily_limit: int, late_days: int):
        self.limit, self.late = daily_limit, late_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ts long")
        self.spent = handle.getMapState("spent", "day long", "n long")
        self.receipts = handle.getMapState("receipts", "request_id string", "day long, expires long, finished boolean")

    def _used(self, day: int) -> int:
        return self.spent.getValue((day,))[0] if self.spent.containsKey((day,)) else 0

    def _book(self, day: int, change: int) -> None:
        self.spent.updateValue((day,), (max(0, self._used(day) + change),))

    def _reserve(self, request: str, t: int, receipt) -> str:
        if receipt:
            return "cached" if receipt[2] else "pending"
        day = t // self.DAY
        if self._used(day) >= self.limit:
            return "quota_exhausted"
        self._book(day, 1)
        self.receipts.updateValue((request,), (day, t + self.DAY, False))
        return "reserved"

    def _finish(self, request: str, t: int, receipt) -> str:
        if not receipt:
            return "lost"
        self.receipts.updateValue((request,), (receipt[0], receipt[1], True))
        return "saved"

    def _release(self, request: str, t: int, receipt) -> str:
        if receipt and receipt[2]:
            return "lost"
        if receipt:
            self._book(receipt[0], -1)
            self.receipts.removeKey((request,))
        return "released"

    def _forget(self, newest: int) -> None:
        oldest = newest // self.DAY - self.late
        for key in [k for k, _ in self.spent.iterator() if k[0] < oldest]:
            self.spent.removeKey(key)
        for key in [k for k, v in self.receipts.iterator() if v[1] <= oldest * self.DAY]:
            self.receipts.removeKey(key)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = sorted((_micros(t), i, r, o) for batch in rows for i, (t, r, o) in enumerate(zip(batch["ts"], batch["request_id"], batch["op"])))
        newest = self.newest.get()[0] if self.newest.exists() else calls[0][0]
        answers = {"reserve": self._reserve, "finish": self._finish, "release": self._release}
        out = []
        for t, _, request, op in calls:
            if t > newest:
                if t // self.DAY != newest // self.DAY:
                    self._forget(t)
                newest = t
            day = t // self.DAY
            if day < newest // self.DAY - self.late:
                out.append((key[0], request, _stamp(t), op, "too_late", 0))
                continue
            receipt = self.receipts.getValue((request,)) if self.receipts.containsKey((request,)) else None
            status = answers[op](request, t, receipt if receipt and receipt[1] > t else None)
            out.append((key[0], request, _stamp(t), op, status, int(self._used(day))))
        self.newest.update((newest,))
        yield pd.DataFrame(out, columns=["scope", "request_id", "ts", "op", "status", "used"])

    def close(self) -> None:
        pass


def stream_quota_ledger(attempts: DataFrame, daily_limit: int, late_days: int = 2) -> DataFrame:
    """``attempts(scope, request_id, ts, op)`` with op reserve, finish or release; calls may be ``late_days`` late."""
    return attempts.groupBy("scope").transformWithStateInPandas(_Ledger(daily_limit, late_days), LEDGER, outputMode="append", timeMode="None")


def stream_case_state(events: DataFrame, case: str, order: str, fields: list[str]) -> DataFrame:
    """Latest non-null field values and version per case (update mode)."""
    latest = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return events.groupBy(case).agg(*latest, F.count(F.lit(1)).alias("version"))


def stream_evaluation(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Running evaluation counts with intervals (complete mode)."""
    return with_rates(outcomes.groupBy(*by).agg(*count_columns()))


def stream_dedup(messages: DataFrame, digest: str, ts: str, retention: str) -> DataFrame:
    """Exact content once within the retention time."""
    return messages.withWatermark(ts, retention).dropDuplicatesWithinWatermark([digest])


def stream_windows(events: DataFrame, ts: str, by: list[str], width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts; rows behind the watermark are dropped."""
    return window_report(events.withWatermark(ts, delay), ts, by, width, slide)


def score_stream(messages: DataFrame, scorer, sink_path: str, checkpoint: str):
    """Score message files as they arrive: every micro-batch runs the batch plan and appends verdicts."""

    def write(batch: DataFrame, epoch: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
