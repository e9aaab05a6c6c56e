"""Streaming forms: stateless operators as they are, latches and idle expiry with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import pressure, waits


def log_breach_stream(samples: DataFrame, max_bytes: int, max_pct: int) -> DataFrame:
    return pressure.log_breach(samples, max_bytes, max_pct)


def classified_wait_stream(steps: DataFrame) -> DataFrame:
    return waits.classify_waits(steps)


class Latch(StatefulProcessor):
    """Fires at ``fire`` or more and stays silent until a reading below ``rearm``; a key's rows of a batch are taken in time order."""

    def __init__(self, fire: float, rearm: float):
        self.fire, self.rearm = fire, rearm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("on", "on boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        on = bool(self.state.get()[0]) if self.state.exists() else False
        every = pd.concat(list(rows)).sort_values(["poll_ts", "used_percent"])
        fired = []
        for i, v in enumerate(every["used_percent"]):
            if v >= self.fire and not on:
                on = True
                fired.append(i)
            elif v < self.rearm:
                on = False
        self.state.update((on,))
        yield every.iloc[fired][["server", "poll_ts", "used_percent"]]

    def close(self) -> None:
        pass


def log_full_alarm_stream(samples: DataFrame, fire: float = 90, rearm: float = 85) -> DataFrame:
    """The log alarm on a stream of (server, poll_ts timestamp, used_percent)."""
    return samples.groupBy("server").transformWithStateInPandas(Latch(fire, rearm), "server string, poll_ts timestamp, used_percent double", "Append", "None")
