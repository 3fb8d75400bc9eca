"""Progress of batch and stream runs as rows and events."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

STAGES = ["starting", "searching", "crawling", "extracting", "ranking", "complete"]


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """df that counts its rows while it runs; the observation has the count when it is done."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def event(kind: str, data: dict) -> str:
    return f"event: {kind}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"


class Progress(StreamingQueryListener):
    """Calls back with an event's text for each micro-batch, at the end and on failure."""

    def __init__(self, emit: Callable[[str], None], every: int = 1):
        self.emit, self.every, self.done = emit, every, False

    def onQueryStarted(self, e) -> None:
        self.emit(event("progress", {"stage": "starting"}))

    def onQueryProgress(self, e) -> None:
        if e.progress.batchId % self.every == 0:
            self.emit(event("progress", {"stage": "extracting", "rows": e.progress.numInputRows, "batch": e.progress.batchId}))

    def onQueryIdle(self, e) -> None:
        pass

    def onQueryTerminated(self, e) -> None:
        self.emit(event("error", {"message": "the search failed"}) if e.exception else event("complete", {"stage": "complete"}))


class Fresh:
    """A frame that is loaded anew when it is older than some minutes."""

    def __init__(self, load: Callable[[], DataFrame], minutes: float = 5, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock, self.at, self.df = load, minutes * 60, clock, None, None

    def get(self) -> DataFrame:
        if self.at is None or self.clock() - self.at > self.seconds:
            if self.df is not None:
                self.df.unpersist()
            self.df, self.at = self.load().cache(), self.clock()
        return self.df
