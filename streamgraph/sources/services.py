"""Business services as periodic bounded sources; ``service`` objects are injected and tested with fakes."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ACCOUNT, INVOICE

INVOICE_FIELDS = [f.split()[0] for f in INVOICE.split(", ")]
ACCOUNT_FIELDS = [f.split()[0] for f in ACCOUNT.split(", ")]
# Seconds between two readings of a service.
POLL_SECONDS = {"sobjects": 1800, "billing": 3600}


class Polled:
    """A listing that is read whole once in every period; the position is the number of the period, so a restart does not ask twice in one."""

    period = POLL_SECONDS["billing"]
    clock = staticmethod(time.time)

    def now(self) -> int:
        return int(self.clock() // self.period)

    def earliest(self) -> dict[str, int]:
        return dict.fromkeys(self.partitions(), 0)

    def latest(self, start: dict[str, int]) -> dict[str, int]:
        return dict.fromkeys(self.partitions(), self.now())

    def commit(self, positions: dict) -> None:
        pass


class Records(Polled):
    """A listing as one partition: ``service.list(kind)`` gives mappings; the fields of ``kind`` are projected."""

    def __init__(self, service, kind: str):
        self.service, self.kind = service, kind
        self.fields, self._schema = {"invoices": (INVOICE_FIELDS, INVOICE), "accounts": (ACCOUNT_FIELDS, ACCOUNT)}[kind]

    def schema(self) -> str:
        return self._schema

    def partitions(self) -> list[str]:
        return [self.kind]

    def read(self, partition: str, start, end) -> Iterator[tuple]:
        for record in self.service.list(self.kind):
            yield tuple(record.get(f) for f in self.fields)


class Sobjects(Polled):
    """The rows of a query as JSON by id, without their ``attributes``."""

    period = POLL_SECONDS["sobjects"]

    def __init__(self, service, query: str):
        self.service, self.query = service, query

    def schema(self) -> str:
        return "root_id string, content string"

    def partitions(self) -> list[str]:
        return ["query"]

    def read(self, partition: str, start, end) -> Iterator[tuple]:
        import json

        for row in self.service.query(self.query):
            yield row["Id"], json.dumps({k: v for k, v in row.items() if k != "attributes"})


class Pushed:
    """Frames of a push service with a replay number: ``service.frames(topic, after)`` gives [(number, frame)]; see ``sobject_updates``."""

    def __init__(self, service, topic: str):
        self.service, self.topic = service, topic

    def schema(self) -> str:
        return "number bigint, frame string"

    def partitions(self) -> list[str]:
        return [self.topic]

    def read(self, partition: str, start, end) -> Iterator[tuple]:
        for number, frame in self.service.frames(self.topic, start or 0):
            if end is None or number <= end:
                yield number, frame

    def earliest(self) -> dict[str, int]:
        return {self.topic: 0}

    def latest(self, start: dict[str, int]) -> dict[str, int]:
        after = int(start.get(self.topic, 0))
        return {self.topic: max([after, *(n for n, _ in self.service.frames(self.topic, after))])}

    def commit(self, positions: dict) -> None:
        pass


def sobject_updates(frames: DataFrame, column: str = "frame") -> DataFrame:
    """(key, content) of push frames that hold ``data.sobject``; heartbeats and handshakes are left out."""
    body = F.get_json_object(column, "$.data.sobject")
    return frames.where(body.isNotNull()).select(F.get_json_object(body, "$.Id").alias("key"), body.alias("content"))
