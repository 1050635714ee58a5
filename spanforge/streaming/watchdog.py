"""Stale-run watchdog: batch rule and its streaming twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import to_ms, use_store

#: fixed value: a running job must report at least this often (minutes)
STALE_MINUTES = 45


def latest_status(updates: DataFrame) -> DataFrame:
    """Last status per recording from ``(vid, updated, status)``."""
    return updates.groupBy("vid").agg(F.max_by(F.struct("updated", "status"), "updated").alias("s")).select("vid", "s.updated", "s.status")


def stale_status(latest: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Derived status: a silent running job reads as failed; nothing is changed."""
    age = F.unix_timestamp(now) - F.unix_timestamp("updated")
    stalled = F.startswith("status", F.lit("Processing")) & (age > minutes * 60)
    text = F.concat(F.lit("Failed: stalled (no update for "), F.floor(age / 60).cast("string"), F.lit(" min)"))
    return latest.withColumn("stalled", F.coalesce(stalled, F.lit(False))).withColumn("status", F.when(F.col("stalled"), text).otherwise(F.col("status")))


def progress_pct(stage: Column, current: Column, total: Column) -> Column:
    """Overall percent of a three-stage run."""
    frac = ((stage - 1) + F.greatest(F.least(current, total), F.lit(0)) / total) / 3.0
    return F.when(stage.isin(1, 2, 3) & (total > 0), F.bround(frac * 100, 0).cast("int"))


_OUT = "vid string, updated timestamp, status string, stalled boolean"
_STATE = "updated_ms long, status string, due long"


class Watch(StatefulProcessor):
    """Last status of each recording and a timer on the wall clock."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", _STATE)

    def _row(self, vid: str, ms: int, status: str, now: int | None = None) -> pd.DataFrame:
        if now is not None:
            status = f"Failed: stalled (no update for {(now - ms) // 60_000} min)"
        return pd.DataFrame({"vid": [vid], "updated": [pd.Timestamp(ms, unit="ms")], "status": [status], "stalled": [now is not None]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        x = pd.concat([p for p in rows if len(p)] or [pd.DataFrame({"updated": [], "status": []})]).dropna(subset="updated")
        if not len(x):
            return
        newest = x.sort_values("updated", kind="stable").iloc[-1]
        ms, status = to_ms(newest["updated"]), newest["status"]
        if held and ms < held[0]:
            return
        if held:
            self.handle.deleteTimer(held[2])
        now = timerValues.getCurrentProcessingTimeInMs()
        yield self._row(key[0], ms, status)
        # a finished run is remembered as long, so that older rows arriving late do not revive it
        due = max(ms + self.limit_ms, now) + 1
        self.handle.registerTimer(due)
        self.state.update((ms, status, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        ms, status, _ = self.state.get()
        self.state.clear()
        if str(status).startswith("Processing"):
            yield self._row(key[0], ms, status, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def watch(updates: DataFrame, minutes: float = STALE_MINUTES) -> DataFrame:
    """Streaming watchdog: every change, and a stalled row once ``minutes`` have passed on the clock.

    The timer runs on processing time, so a stream without any further row reports too
    (with a trigger that keeps running).  State per recording is one timestamp, one
    status and one timer, removed when the timer fires.
    """
    use_store(updates.sparkSession)
    x = updates.select(F.col("vid").cast("string").alias("vid"), "updated", "status")
    return x.groupBy("vid").transformWithStateInPandas(Watch(int(minutes * 60_000)), _OUT, "append", "processingTime")
