"""A Spark data source over a client object: brokers with shards, queues, REST services.

The option ``factory`` names a callable ``module:name``; called with the options, it gives a client with

* ``schema()``: DDL of the rows,
* ``partitions()``: names of shards (one for a queue or service),
* ``read(partition, start, end)``: rows (tuples) from position ``start`` up to ``end`` (None: all),

and for streams also ``earliest()``: a position per shard, ``latest(start)``: positions to read up to, which bounds a
batch, and ``commit(positions)``: called when a batch has been processed. Spark's offset log is the checkpoint; shards are
dealt to tasks by Spark, so there are no leases.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def client(options: dict):
    module, _, name = options["factory"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


@dataclass
class Slice(InputPartition):
    shard: str
    start: object = None
    end: object = None


class ClientSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "client"

    def schema(self) -> str:
        return client(self.options).schema()

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Slice(p) for p in client(self.options).partitions()]

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from client(self.options).read(partition.shard, None, None)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self._client, self._at = None, None

    @property
    def client(self):
        if self._client is None:
            self._client = client(self.options)
        return self._client

    def __getstate__(self) -> dict:
        return {"options": self.options, "_client": None, "_at": None}

    def initialOffset(self) -> dict:
        return dict(self.client.earliest())

    def latestOffset(self) -> dict:
        self._at = dict(self.client.latest(self._at or self.initialOffset()))
        return self._at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._at = self._at or dict(end)
        return [Slice(p, start.get(p), e) for p, e in sorted(end.items()) if start.get(p) != e]

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from self.client.read(partition.shard, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        self.client.commit(end)
