"""A composite that is kept per pixel: the latest valid value and a running median, as state of a stream.

Each pixel's state is the latest observation by event time and a summary of all values: exact while there are few, then a fixed
number of evenly spaced order statistics with weights, which merges with what comes. Late rows count by their own time. A timer
evicts pixels that nothing has been seen of for a while. The state lives in Spark's state store, so a stream that is stopped and
started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Values that a summary holds at most; up to so many the median is exact.
HELD_VALUES = 256
OUTPUT = "row int, col int, n long, latest_ts timestamp, latest float, median double"


def merged(values: np.ndarray, weights: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A summary with more values: all of them, in order, or as many weighted ones of equal share."""
    values, weights = np.concatenate([values, new]), np.concatenate([weights, np.ones(len(new))])
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    if len(values) <= HELD_VALUES:
        return values, weights
    ends = np.cumsum(weights)
    at = (np.arange(HELD_VALUES) + 0.5) * ends[-1] / HELD_VALUES
    return values[np.searchsorted(ends, at)], np.full(HELD_VALUES, ends[-1] / HELD_VALUES)


def median(values: np.ndarray, weights: np.ndarray) -> float:
    """The middle of a summary; the mean of the two middle ones of an even number of single values."""
    ends = np.cumsum(weights)
    low, high = (values[min(int(np.searchsorted(ends, x)), len(values) - 1)] for x in ((ends[-1] - 1) / 2 + 1e-9, (ends[-1] + 1) / 2 - 1e-9))
    if (weights == 1).all():
        return float(np.median(values))
    return float((low + high) / 2)


class PixelState(StatefulProcessor):
    """State and output of one pixel."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pixel", "n long, latest_ts timestamp, latest float, seen array<double>, weights array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, latest_ts, latest, seen, weights = self.state.get() if self.state.exists() else (0, None, None, [], [])
        seen, weights = np.array(seen, float), np.array(weights, float)
        for part in rows:
            part = part[part["value"].notna() & part["ts"].notna()]
            if part.empty:
                continue
            n += len(part)
            last = part.sort_values(["ts", "value"]).iloc[-1]
            if latest_ts is None or (last["ts"], float(last["value"])) >= (pd.Timestamp(latest_ts), float(latest)):
                latest_ts, latest = last["ts"].to_pydatetime(), float(last["value"])
            seen, weights = merged(seen, weights, part["value"].to_numpy(float))
        if not n:
            return
        self.state.update((n, latest_ts, latest, seen.tolist(), weights.tolist()))
        if self.idle_ms is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle_ms)
        yield pd.DataFrame({"row": [key[0]], "col": [key[1]], "n": [n], "latest_ts": [latest_ts], "latest": np.array([latest], np.float32), "median": [median(seen, weights)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_composite(observations: DataFrame, late: str = "30 days", idle_ms: int | None = None) -> DataFrame:
    """row, col, n, latest_ts, latest, median of a stream of observations (row, col, ts, value): a row whenever a pixel changes.

    ``late`` holds the watermark behind the newest observation; ``idle_ms``: the event time after which an unseen pixel is
    forgotten (None: never). Nodata (NULL) drops out. The session needs the RocksDB state store, which ``stateful_session`` sets.
    """
    rows = observations.select("row", "col", "ts", observations["value"].cast("float").alias("value")).withWatermark("ts", late)
    return rows.groupBy("row", "col").transformWithStateInPandas(PixelState(idle_ms), OUTPUT, "Update", "EventTime" if idle_ms is not None else "None")


def stateful_session(spark) -> None:
    """Sets the state store that such streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
