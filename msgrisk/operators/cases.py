"""Review writes under an optimistic version check."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A case's statuses and what may follow each; a new case is pending at version 0.
NEXT_STATUS = {"pending": {"pending", "in_progress"}, "in_progress": {"in_progress", "closed"}, "closed": {"in_progress"}}
NEW_CASE = (0, "pending", None)

ATTEMPT = ["case_id", "ts", "seq", "expected_version", "status", "verdict"]


def settle(case: tuple[int, str, str | None], expected: int | None, status: str | None, verdict: str | None):
    """The case after one write, and what became of the write; only ``applied`` changes anything.

    A write states the version it was made for. ``conflict``: the case has moved on (or no version was given);
    ``invalid_transition``, ``verdict_required`` and ``unchanged`` are judged on the current version only.
    """
    version, current, known = case
    if expected != version:
        return case, "conflict"
    if status not in NEXT_STATUS[current]:
        return case, "invalid_transition"
    if status == "closed" and verdict is None:
        return case, "verdict_required"
    if (status, verdict) == (current, known):
        return case, "unchanged"
    return (version + 1, status, verdict), "applied"


def case_attempts(attempts: DataFrame) -> DataFrame:
    """``attempts(case_id, ts, seq, expected_version, status, verdict)`` in time order, each with its outcome.

    Adds outcome and the case's version, status and verdict after the write (``case_*``). Applied and refused writes are the
    two outputs, told apart by ``outcome``. Rows without a case are ``invalid_case``. A case is decided write by write: its
    rows stream through one task, which holds nothing but its current state.
    """
    fields = {f.name: f.dataType.simpleString() for f in attempts.select(*ATTEMPT).schema}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in fields.items()), "outcome string, case_version long, case_status string, case_verdict string"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, case = None, NEW_CASE
        for rows in batches:
            out = []
            for case_id, expected, status, verdict in zip(*(rows[c].astype(object).where(rows[c].notna(), None) for c in ("case_id", "expected_version", "status", "verdict"))):
                if case_id is None:
                    out.append(("invalid_case", None, None, None))
                    continue
                if case_id != last:
                    last, case = case_id, NEW_CASE
                case, outcome = settle(case, expected, status, verdict)
                out.append((outcome, *case))
            added = pd.DataFrame(out, columns=["outcome", "case_version", "case_status", "case_verdict"], index=rows.index)
            yield pd.concat([rows, added.astype({"case_version": "Int64"})], axis=1)

    ordered = attempts.select(*ATTEMPT).repartition("case_id").sortWithinPartitions("case_id", "ts", "seq")
    return ordered.mapInPandas(fold, schema)


def refused(settled: DataFrame) -> DataFrame:
    """Writes to be made again after a reload."""
    return settled.where(F.col("outcome") != "applied")
