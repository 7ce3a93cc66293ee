"""Completion of message trees on a stream of progress events (see ``operators.tracking`` for bounded tables).

State per (producer, root_id): two XOR lanes and the time of the first event. A micro-batch's events of a tree are
folded before the state is judged, so no order within a batch completes a tree early.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "producer string, root_id string, status string, error_message string"
TIMEOUT_MS = 30 * 60 * 1000


class Tracker(StatefulProcessor):
    """One row per finished tree: success, failed or timeout. A failure that comes first counts as a failure."""

    def __init__(self, timeout_ms: int = TIMEOUT_MS):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tree", "hi bigint, lo bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        hi, lo = self.state.get() if known else (0, 0)
        error = None
        for pdf in rows:
            failed = pdf["is_fail"].fillna(False).astype(bool)
            if failed.any():
                error = next((e for e in pdf.loc[failed, "error_message"] if isinstance(e, str)), "failed")
            for h, v in zip(pdf.loc[~failed, "ack_hi"].fillna(0), pdf.loc[~failed, "ack_lo"].fillna(0), strict=True):
                hi, lo = hi ^ int(h), lo ^ int(v)
        if error is None and (hi or lo):
            if not known:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            self.state.update((hi, lo))
            return
        self._forget()
        yield self._row(key, "success" if error is None else "failed", error)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield self._row(key, "timeout", "no outcome in time")

    def _forget(self) -> None:
        self.state.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)

    @staticmethod
    def _row(key, status: str, error: str | None) -> pd.DataFrame:
        return pd.DataFrame({"producer": [key[0]], "root_id": [key[1]], "status": [status], "error_message": [error]})

    def close(self) -> None:
        pass


def outcomes(control: DataFrame, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """A stream of outcomes from a stream of progress events. Needs the RocksDB state store: set
    ``spark.sql.streaming.stateStore.providerClass`` to ``ROCKSDB`` before the query starts.
    """
    keyed = control.groupBy("producer", "root_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Tracker(timeout_ms), outputStructType=OUTCOME, outputMode="Append", timeMode="ProcessingTime")
