"""Throttling frames: a frame is analysed if none is being analysed and the last one was started long enough ago."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vellum.streaming.stabilizer import SILENCE_MS, in_time, timed

INTERVAL_MS = 250


def accepted(times: np.ndarray, works: np.ndarray, free: int | None, interval_ms: int) -> tuple[list[int], int | None]:
    """Which frames are analysed, from one to the next that comes when the camera is free again; and when it is free at the end."""
    kept, k = [], 0 if free is None else int(np.searchsorted(times, free))
    while k < len(times):
        kept.append(k)
        free = int(times[k]) + max(interval_ms, int(works[k]))
        k = max(k + 1, int(np.searchsorted(times, free)))
    return kept, free


def throttle_batch(frames: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """Stored frames that are analysed: those that start ``interval_ms`` at least after the last that was, and not before its analysis, of
    ``work_ms`` if there is such a column, is over.  One pass in order of time."""
    busy = F.coalesce("work_ms", F.lit(0)).cast("long") if "work_ms" in frames.columns else F.lit(0).cast("long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, free = None, None
        for batch in batches:
            for stream, part in batch.groupby("stream_id", sort=False):
                if stream != at:
                    at, free = stream, None
                kept, free = accepted(part["t_ms"].to_numpy(), part["work_ms"].to_numpy(), free, interval_ms)
                yield part.iloc[kept].drop(columns="work_ms")

    ordered = frames.select("stream_id", "t_ms", "event_id", busy.alias("work_ms")).repartition("stream_id").sortWithinPartitions("stream_id", "t_ms", "event_id")
    return ordered.mapInPandas(run, ordered.drop("work_ms").schema)


class Throttle(StatefulProcessor):
    """When a camera is free again."""

    def __init__(self, interval_ms: int) -> None:
        self.interval_ms = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.free = handle, handle.getValueState("free", "last long, free long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        last, free = self.free.get() if self.free.exists() else (None, None)
        frames = in_time(rows, last)
        if len(frames):
            kept, free = accepted(frames["t_ms"].to_numpy(), frames["work_ms"].to_numpy(), free, self.interval_ms)
            self.free.update((int(frames["t_ms"].iloc[-1]), int(free)))
            yield frames.iloc[kept][["stream_id", "t_ms", "event_id"]]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last or 0, timerValues.getCurrentWatermarkInMs()) + SILENCE_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.free.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle_stream(frames: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """The same on a stream."""
    busy = F.coalesce("work_ms", F.lit(0)).cast("long") if "work_ms" in frames.columns else F.lit(0).cast("long")
    return timed(frames.withColumn("work_ms", busy)).groupBy("stream_id").transformWithStateInPandas(Throttle(interval_ms), "stream_id long, t_ms long, event_id long", "Append", "EventTime")
