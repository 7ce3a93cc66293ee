"""Adapters to message brokers. Their servers can't be reached here; they are tested with fake clients and by their options."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import message_id
from ..schema import decode

# Limits of the services and of fair use of them.
KAFKA_PER_POLL, KINESIS_PER_CALL, SHARD_OPEN = 1000, 1000, 3000
SQS_RECEIVE, SQS_WAIT_S, SQS_VISIBILITY_S = 10, 5, 600


def kafka_options(topic: str, servers: str | None = None, per_trigger: int = 10_000, start: str = "latest", **more: str) -> dict[str, str]:
    """Options of Spark's own Kafka source; servers default to the variable KAFKA_BROKER_URL. Needs the connector's jar."""
    servers = servers or os.environ.get("KAFKA_BROKER_URL", "localhost:9092")
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "false", **more}


def kafka_stream(spark: SparkSession, topic: str, **options: str) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(topic, **options)).load()


def kafka_messages(records: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(messages: root_id, key, content; dead letters) of records (topic, partition, offset, key, value). Ids hold the topic, so topics don't collide."""
    rows = records.select(
        F.concat_ws("-", "topic", message_id(F.col("partition"), F.col("offset"))).alias("root_id"), F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("body")
    )
    good, bad = decode(rows, "body", schema)
    return good.drop("body"), bad


def messages(records: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(messages with ``content`` as a struct; dead letters) of what ``Shards`` and ``Queue`` give: root_id, key, content as JSON."""
    good, bad = decode(records.withColumnRenamed("content", "body"), "body", schema)
    return good.drop("body"), bad


class Shards:
    """Base of brokers with numbered positions: ``limit`` records a shard and batch.

    Option ``start``, where no checkpoint says otherwise: ``earliest``, ``latest`` (default: what comes from now on), or JSON of a
    position per shard, whose record is read again; shards that it leaves out start at their latest.
    """

    limit = SHARD_OPEN

    def __init__(self, options: dict):
        self.options = options
        self.limit = int(options.get("limit", self.limit))
        self.start = options.get("start", "latest")

    def schema(self) -> str:
        return "root_id string, key string, content string"

    def partitions(self) -> list[str]:
        raise NotImplementedError

    def end(self, shard: str) -> int:
        raise NotImplementedError

    def records(self, shard: str, start: int, end: int | None) -> Iterator[tuple[int, str | None, str]]:
        raise NotImplementedError

    def begin(self, shard: str) -> int:
        """The first position that the broker still has."""
        return 0

    def earliest(self) -> dict[str, int]:
        if self.start == "earliest":
            return {p: self.begin(p) for p in self.partitions()}
        given = {} if self.start == "latest" else json.loads(self.start)
        return {p: int(given[p]) if p in given else self.end(p) for p in self.partitions()}

    def lag(self, positions: dict[str, int]) -> int:
        """Records that wait beyond the positions."""
        return sum(max(0, self.end(p) - int(positions.get(p, 0))) for p in self.partitions())

    def latest(self, start: dict[str, int]) -> dict[str, int]:
        return {p: min(self.end(p), int(start.get(p, 0)) + self.limit) for p in self.partitions()}

    def read(self, shard: str, start: int | None, end: int | None) -> Iterator[tuple]:
        for at, key, content in self.records(shard, int(start or 0), end):
            yield f"{shard}-{at}", key, content

    def commit(self, positions: dict) -> None:
        pass


class Queue:
    """A queue with receipts: what a batch has received is deleted when the batch is done, and comes again if it fails.

    ``service``: an object with lookup(name) -> a handle or None, create(name) -> a handle, receive(handle, n, wait_s, visibility_s) ->
    [(receipt, body)] and delete(handle, receipts). Bodies are received by tasks and lie in ``folder``, which driver and executors
    share (a batch is one file each); the offset log holds the names of the files only, and a batch that runs again reads the same file.
    """

    def __init__(self, service, name: str, folder: str, json_group_key: str | None = None, most: int = 1000):
        self.service, self.name, self.folder, self.json_group_key, self.most = service, name, folder, json_group_key, most
        self._handle = None
        self._done: set[str] = set()

    def handle(self):
        """The queue, created if there is none of that name; asked for once."""
        if self._handle is None:
            self._handle = self.service.lookup(self.name) or self.service.create(self.name)
        return self._handle

    def schema(self) -> str:
        return "root_id string, key string, content string"

    def partitions(self) -> list[str]:
        return [uuid.uuid4().hex]

    def _file(self, batch: str, kind: str = "json") -> str:
        return os.path.join(self.folder, f"{batch}.{kind}")

    def receive(self, batch: str) -> list:
        """What a batch holds: received once and written down."""
        if not os.path.exists(self._file(batch)):
            out: list = []
            while len(out) < self.most and (got := self.service.receive(self.handle(), min(SQS_RECEIVE, self.most - len(out)), SQS_WAIT_S, SQS_VISIBILITY_S)):
                out += got
            os.makedirs(self.folder, exist_ok=True)
            part = self._file(batch, uuid.uuid4().hex)
            with open(part, "w", encoding="utf-8") as f:
                json.dump(out, f)
            os.replace(part, self._file(batch))
        with open(self._file(batch), encoding="utf-8") as f:
            return json.load(f)

    def read(self, shard: str, start, end) -> Iterator[tuple]:
        for receipt, body in self.receive(end or shard):
            yield receipt, self._key(body), body

    def _key(self, body: str) -> str | None:
        if not self.json_group_key:
            return None
        try:
            value = json.loads(body).get(self.json_group_key)
        except (ValueError, AttributeError):  # no JSON object: the row goes on without a key, and fails where it is decoded
            return None
        return None if value is None else str(value)

    def earliest(self) -> dict:
        return {"queue": ""}

    def latest(self, start: dict) -> dict:
        return {"queue": uuid.uuid4().hex}

    def commit(self, positions: dict) -> None:
        """Delete what the batch has received, but for receipts in its ``.failed`` file: those come again when their time is over."""
        batch = positions.get("queue")
        if batch and os.path.exists(self._file(batch)):
            failed = set()
            if os.path.exists(self._file(batch, "failed")):
                with open(self._file(batch, "failed"), encoding="utf-8") as f:
                    failed = set(f.read().split("\n"))
            self.service.delete(self.handle(), [receipt for receipt, _ in self.receive(batch) if receipt not in failed])
            os.remove(self._file(batch))

    def redeliver(self, batch: str, receipts: list[str]) -> None:
        """Leave these receipts of a batch with the service."""
        os.makedirs(self.folder, exist_ok=True)
        with open(self._file(batch, "failed"), "a", encoding="utf-8") as f:
            f.writelines(f"{r}\n" for r in receipts)
