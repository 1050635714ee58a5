"""Online window detection: the streaming twin of the batch hysteresis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..machines import TwoThresholds
from .state import to_ms, use_store

_OUT = "vid string, start_s int, end_s int, source string, n_rows long"
#: last second seen, state of the machine (-1: none), event time the expiry waits for
_STATE = "last int, run int, start int, due long"


class OnlineWindows(StatefulProcessor):
    """One machine per recording, and a timer for its end."""

    def __init__(self, machine: TwoThresholds, idle_ms: int):
        self.machine, self.idle_ms = machine, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", _STATE)

    def advance(self, state: list, t: np.ndarray, m: np.ndarray) -> tuple[list, list[tuple]]:
        """Run the machine; while it is idle, seconds that are not active are passed over at once."""
        active = np.flatnonzero(m >= self.machine.open_at)
        out, k, n = [], 0, len(t)
        while k < n:
            if not state:
                k = n if (at := np.searchsorted(active, k)) == len(active) else int(active[at])
                if k == n:
                    break
            state, window = self.machine.step(state, int(t[k]), float(m[k]))
            if window:
                out.append(window)
            k += 1
        return state, out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, run, start, due = self.state.get() if self.state.exists() else (-1, -1, -1, -1)
        x = pd.concat([p for p in rows if len(p)] or [pd.DataFrame({"t": [], "motion": [], "at": []})]).sort_values("t", kind="stable")
        late = int((x["t"] <= last).sum()) + int(x["t"][x["t"] > last].duplicated().sum())
        x = x[x["t"] > last].drop_duplicates("t")
        if late:
            yield pd.DataFrame({"vid": [key[0]], "start_s": [None], "end_s": [None], "source": ["late"], "n_rows": [late]})
        if not len(x):
            return
        state, windows = self.advance([] if run < 0 else [run, start], x["t"].to_numpy(), x["motion"].fillna(float("-inf")).to_numpy())
        if due >= 0:
            self.handle.deleteTimer(due)
        due = max(to_ms(x["at"].max()), due - self.idle_ms) + self.idle_ms
        self.handle.registerTimer(due)
        self.state.update((int(x["t"].iloc[-1]), *(map(int, state) if state else (-1, -1)), due))
        if windows:
            yield pd.DataFrame([(key[0], *w, None) for w in windows], columns=["vid", "start_s", "end_s", "source", "n_rows"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        last, run, start, _ = self.state.get()
        self.state.clear()
        if run == 0:
            yield pd.DataFrame([(key[0], start, last + 1, "motion_eof", None)], columns=["vid", "start_s", "end_s", "source", "n_rows"])

    def close(self) -> None:
        pass


def online_windows(
    signals: DataFrame, open_at: float = 3.0, stop_at: float = 1.2, min_run: int = 8, max_open: int = 30,
    at: Column | None = None, idle: str = "2 minutes", late: str = "10 seconds",
) -> DataFrame:
    """Windows as they close, from a stream of ``(vid, t, motion)``.

    ``at`` is the event time of a row (default: second ``t`` + 1 of the epoch, since the first watermark is 0).  Seconds of
    a recording are taken in order; a second that is not beyond the last one taken is
    counted in a row with source ``late`` (rows older than the watermark, which trails by
    ``late``, are dropped by Spark and counted in the query's metrics).  When the watermark is
    ``idle`` past a recording's last row, its open window is reported as ``motion_eof``
    and its state is removed.  State is four numbers and a timer.
    """
    use_store(signals.sparkSession)
    when = F.timestamp_seconds(F.col("t") + 1) if at is None else at
    x = signals.select(F.col("vid").cast("string").alias("vid"), F.col("t").cast("int").alias("t"), F.col("motion").cast("double").alias("motion"), when.alias("at"))
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    processor = OnlineWindows(TwoThresholds(open_at, stop_at, min_run, max_open), wait)
    return x.withWatermark("at", late).groupBy("vid").transformWithStateInPandas(processor, _OUT, "append", "eventTime")
