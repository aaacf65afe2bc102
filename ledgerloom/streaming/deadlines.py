"""The refund clock as a stream: state for each lease and timers.

Events of leases (keys returned on a day, refunds) and of the calendar arrive as rows; the
watermark, the newest time of arrival, is the calendar.  The day of the keys is a value of its
own, so keys that are entered late are not late events.  A lease whose keys are back has a timer at its next stage's day; when it runs
out the stage is given out, once, and the timer of the next one is set.  Keys that come late
have all reached stages at once, as after a clock that stood still.  A refund (any net amount
other than 0) stops the clock, its reversal starts it again after the last stage given.  When
the last stage is out nothing but that number stays.  State and timers are in Spark's
checkpoint, so a restarted stream goes on where it stopped and gives no stage twice.

Needs the RocksDB state store (STATE_STORE).  Edge cases: a second return of keys counts
anew only if its day is later; keys without a day count for nothing, null amounts are 0; rows
without a lease only move the calendar; rows that arrive more than ``late`` out of order are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.deadlines import DUE_DAYS, STAGES

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENT = "lease_id long, what string, day date, amount long, ts timestamp"
OUT = "lease_id long, stage string, due_on date, days_left int"
DAY = 24 * 3600 * 1000


class Clock(StatefulProcessor):
    """keys: the day (ms) on which keys came back, paid: net refunds, given: stages given out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "keys long, paid long, given int")

    def _read(self) -> tuple[int | None, int, int]:
        return tuple(self.lease.get()) if self.lease.exists() else (None, 0, 0)

    def _next(self, keys: int | None, paid: int, given: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if keys is not None and not paid and given < len(STAGES):
            self.handle.registerTimer(keys + STAGES[given][1] * DAY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys, paid, given = self._read()
        for frame in rows:
            for r in frame.itertuples():
                if r.what == "keys" and not pd.isna(r.day):
                    day = int(pd.Timestamp(r.day).value // 10**6)
                    if keys is None or day > keys:
                        keys, given = day, 0
                elif r.what == "refund" and not pd.isna(r.amount):
                    paid += int(r.amount)
        self.lease.update((keys, paid, given))
        self._next(keys, paid, given)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, paid, given = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        out = []
        while keys is not None and not paid and given < len(STAGES) and keys + STAGES[given][1] * DAY <= now:
            due = keys + DUE_DAYS * DAY
            out.append((key[0], STAGES[given][0], pd.Timestamp(due, unit="ms").date(), (due - now // DAY * DAY) // DAY))
            given += 1
        self.lease.update((keys, paid, given))
        self._next(keys, paid, given)
        if out:
            yield pd.DataFrame(out, columns=["lease_id", "stage", "due_on", "days_left"])


def stages(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stages (lease_id, stage, due_on, days_left) of a stream of events (EVENT) as their days
    come; the stream's newest time is the calendar's day."""
    e = events.withWatermark("ts", late).withColumn("lease_id", F.coalesce("lease_id", F.lit(-1)))
    return e.groupBy("lease_id").transformWithStateInPandas(Clock(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
