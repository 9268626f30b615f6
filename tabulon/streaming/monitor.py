"""Watches batches until each has ended: one row a batch, from polls of its state in any order."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States after which a batch has none any more, and what is made of them.
ENDED = {"completed": "completed", "failed": "failed", "expired": "expired", "cancelled": "cancelled"}
_OUT = "batch_id string, outcome string, at long, output string"


class Watch(StatefulProcessor):
    """The first poll's time and if the batch has ended; a timer ends it when patience is over."""

    def __init__(self, patience: timedelta):
        self.patience = patience // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "deadline long, ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803, the name is the engine's
        deadline, ended = self.seen.get() if self.seen.exists() else (None, False)
        if ended:  # late and repeated states
            return
        first = last = None  # one row is held, however many polls there are
        for r in rows:
            first = r.at if first is None else min(first, r.at)
            if r.state in ENDED and (last is None or (r.at, r.state, r.output or "") < (last.at, last.state, last.output or "")):
                last = r
        if deadline is None:
            deadline = first + self.patience
            self.handle.registerTimer(-(-deadline // 1000))
        if last is not None and last.at <= deadline:
            ended = True
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            lost = last.state == "completed" and not last.output
            yield Row(batch_id=key[0], outcome="completed_without_output" if lost else ENDED[last.state], at=last.at, output=last.output if last.state == "completed" else None)
        self.seen.update((deadline, ended))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        deadline, ended = self.seen.get()
        if not ended:
            self.seen.update((deadline, True))
            yield Row(batch_id=key[0], outcome="timed_out", at=deadline, output=None)

    def close(self) -> None:
        pass


def outcomes(polls: DataFrame, patience: timedelta, late: str) -> DataFrame:
    """batch_id, outcome, ended_at, output: a row for each batch that has ended, once.

    polls: a stream of batch_id, polled_at, state, output. The first end that is
    polled counts if it isn't past the deadline, patience after the batch's
    first poll; a batch without one has timed out when the watermark (late
    behind the newest poll) has passed its deadline. What comes after is
    ignored. Null ids and times are nobody's. Needs state_kept()."""
    known = polls.where("batch_id is not null and polled_at is not null").withWatermark("polled_at", late)
    # times as microseconds: no zone comes between the engine's and the worker's
    timed = known.select("batch_id", "polled_at", F.unix_micros("polled_at").alias("at"), "state", "output")
    found = timed.groupBy("batch_id").transformWithState(Watch(patience), _OUT, "Append", "EventTime")
    return found.select("batch_id", "outcome", F.timestamp_micros("at").alias("ended_at"), "output")
