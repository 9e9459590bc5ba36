"""Review writes on a stream: the state of each case, and conflicts as rows of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from msgrisk.operators.cases import ATTEMPT, NEW_CASE, settle

OUTCOME = ("case_id string, ts timestamp, seq long, expected_version long, status string, verdict string, outcome string, "
           "case_version long, case_status string, case_verdict string")
_COLUMNS = [*ATTEMPT, "outcome", "case_version", "case_status", "case_verdict"]


def _given(value):
    return None if pd.isna(value) else value


class _Cases(StatefulProcessor):
    """Writes wait until the watermark has passed them, so a case sees them in time order whatever order they came in.

    A write behind one that was settled already is answered ``too_late`` and changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", "version long, status string, verdict string, settled long")
        self.waiting = handle.getListState("waiting", "ts long, seq long, expected long, status string, verdict string")

    def _current(self) -> tuple:
        return tuple(self.case.get()) if self.case.exists() else (*NEW_CASE, -1)

    @staticmethod
    def _row(key, write, outcome, case) -> tuple:
        ts, seq, expected, status, verdict = write
        return (key[0], pd.Timestamp(ts, unit="us"), seq, expected, status, verdict, outcome, *case)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_COLUMNS).astype({"expected_version": "Int64", "case_version": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *case, settled = self._current()
        late, writes = [], []
        for batch in rows:
            for values in zip(*(batch[c] for c in ATTEMPT[1:])):
                ts, seq, expected, status, verdict = values
                expected = _given(expected)
                write = (int(pd.Timestamp(ts).value // 1000), int(seq), None if expected is None else int(expected), _given(status), _given(verdict))
                if write[0] <= settled:
                    late.append(self._row(key, write, "too_late", case))
                else:
                    writes.append(write)
        if writes:
            self.waiting.appendList(writes)
            self.handle.registerTimer(min(w[0] for w in writes) // 1000 + 1)
        yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        *case, settled = self._current()
        out, left = [], []
        for write in sorted((tuple(w) for w in self.waiting.get()), key=lambda w: w[:2]) if self.waiting.exists() else []:
            if write[0] > upto:
                left.append(write)
                continue
            case, outcome = settle(tuple(case), write[2], write[3], write[4])
            settled = write[0]
            out.append(self._row(key, write, outcome, case))
        self.case.update((*case, settled))
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        yield self._frame(out)

    def close(self) -> None:
        pass


def stream_case_attempts(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream's form of ``operators.cases.case_attempts``: one row a write, applied or refused, once the watermark is past it.

    ``attempts(case_id string, ts, seq long, expected_version long, status, verdict)``; writes without a case are dropped by
    the watermark's key and should be filtered before.
    """
    known = attempts.select(*ATTEMPT).where("case_id IS NOT NULL").withWatermark("ts", delay)
    return known.groupBy("case_id").transformWithStateInPandas(_Cases(), OUTCOME, outputMode="append", timeMode="EventTime")
