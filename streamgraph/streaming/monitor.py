"""Progress of running queries as rows."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, batch bigint, ts string, input_rows bigint, rows_per_second double, batch_ms bigint, lag string"


class Monitor(StreamingQueryListener):
    """Keeps the last ``keep`` progress reports of all queries and the error of each that died."""

    def __init__(self, keep: int = 1000):
        self._lock = threading.Lock()
        self._rows: deque = deque(maxlen=keep)
        self.errors: dict[str, str] = {}
        self.started: dict[str, str] = {}
        self.observed: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.started[event.name or str(event.id)] = str(event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        lag = next((str(dict(s.metrics)) for s in p.sources if s.metrics), None)
        with self._lock:
            self.observed.setdefault(p.name or str(p.id), {}).update({k: v.asDict() for k, v in (p.observedMetrics or {}).items()})
            self._rows.append((p.name or str(p.id), p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0), int(p.batchDuration), lag))

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            with self._lock:
                self.errors[str(event.id)] = event.exception

    def onQueryIdle(self, event) -> None:
        pass

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self._rows), PROGRESS)
