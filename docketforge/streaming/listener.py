"""A listener that keeps the progress of streaming queries as metric points."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class MetricsListener(StreamingQueryListener):
    """points: the last hundred (query, batch, rows, rows a second) seen."""

    def __init__(self, keep: int = 100):
        self.keep = keep
        self.points: list[tuple[str, int, int, float]] = []
        self.failed: list[str] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.points.append((str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond))
        del self.points[: -self.keep]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.failed.append(event.exception)
