"""User-defined state per key, in Spark's state store: it survives restarts and moves with its key when the number of tasks changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Keyed(StatefulProcessor):
    """``function(key, state, rows)``: the state (a tuple, or None for a new key) and a batch's rows of one key give (new state or None, output frame or None)."""

    def __init__(self, function: Callable[[tuple, tuple | None, pd.DataFrame], tuple[tuple | None, pd.DataFrame | None]], state: str):
        self.function, self.schema = function, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        for part in rows:  # a hot key's rows come in parts, which are never put together
            held, out = self.function(tuple(key), held, part)
            if out is not None and len(out):
                yield out
        if held is None:
            self.state.clear()
        else:
            self.state.update(held)

    def close(self) -> None:
        pass


def stateful(df: DataFrame, keys: list[str], function: Callable, state: str, schema: str) -> DataFrame:
    """A user's stateful operator. state, schema: DDL of the state and of the output. Needs the RocksDB state store (``tracker.ROCKSDB``)."""
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=Keyed(function, state), outputStructType=schema, outputMode="Append", timeMode="None")
