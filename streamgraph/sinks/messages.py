"""Sinks of messages: size guards and clients."""

from __future__ import annotations

import importlib
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import n_bytes
from ..schema import encode

# The services' limits of a message in bytes, and a batch of records.
SQS_BYTES, KAFKA_BYTES, BATCH, SQS_BATCH = 262_144, 1_048_576, 500, 10


def guarded(df: DataFrame, body: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, dead letters); a null body fits, it has no bytes."""
    fits = F.coalesce(n_bytes(F.col(body)), F.lit(0)) <= limit
    return df.where(fits), df.where(~fits).withColumn("error", F.lit(f"over {limit} bytes"))


def kafka_rows(df: DataFrame, key: str, *content: str) -> DataFrame:
    """(key, value) as Spark's Kafka sink takes them."""
    return df.select(F.encode(F.col(key).cast("string"), "UTF-8").alias("key"), encode(F.struct(*content)).alias("value"))


def kafka_options(topic: str, servers: str | None = None, **more: str) -> dict[str, str]:
    """Options of Spark's Kafka sink; servers default to the variable KAFKA_BROKER_URL. Needs the connector's jar."""
    servers = servers or os.environ.get("KAFKA_BROKER_URL", "localhost:9092")
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.enable.idempotence": "true", "kafka.max.request.size": str(KAFKA_BYTES), **more}


def kafka_write(df: DataFrame, topic: str, key: str, *content: str, checkpoint: str | None = None, kind: str = "kafka", **options: str) -> tuple[object, DataFrame]:
    """Write the rows that fit a message to a topic; (the started query, or None of a bounded frame; the dead letters of those that don't fit)."""
    good, bad = guarded(kafka_rows(df, key, *content), "value", KAFKA_BYTES)
    given = kafka_options(topic, **options)
    if df.isStreaming:
        return good.writeStream.format(kind).options(**given).option("checkpointLocation", checkpoint).start(), bad
    good.write.format(kind).options(**given).mode("append").save()
    return None, bad


def queue_write(df: DataFrame, key: str, content: str, factory: str, options: dict | None = None, **how) -> DataFrame:
    """Send rows to a queue service, ten at a time; returns the dead letters: what is too large, and what the service has not taken. Lazy like ``send``."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(content).cast("string").alias("value"))
    good, bad = guarded(rows, "value", SQS_BYTES)
    return send(good, factory, options, batch=SQS_BATCH, **how).unionByName(bad)


def console(df: DataFrame, rows: int = 20, checkpoint: str | None = None):
    """Show rows where the driver runs: those of a bounded frame at once, those of a stream batch by batch (the started query)."""
    if not df.isStreaming:
        df.show(rows, truncate=False)
        return None
    writer = df.writeStream.format("console").option("numRows", rows).option("truncate", "false")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def send(df: DataFrame, factory: str, options: dict | None = None, batch: int = BATCH, tries: int = 5, pause_s: float = 1.0) -> DataFrame:
    """Give rows (key, value) to a client in batches from the tasks; returns those that failed, with ``error``.

    factory: ``module:name`` of a callable that, given the options, makes a client with put([(key, value)]) -> a list with,
    per record, None if taken, ``retry`` if throttled, or an error. Throttled ones alone are put again after a pause. The
    result is lazy: write it (to the dead letters) to send.
    """
    options = dict(options or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = factory.partition(":")
        client = getattr(importlib.import_module(module), name)(options)
        for rows in batches:
            failed: list[tuple] = []
            pairs = list(zip(rows.column("key").to_pylist(), rows.column("value").to_pylist(), strict=True))
            for at in range(0, len(pairs), batch):
                open_ = pairs[at : at + batch]
                for attempt in range(tries):
                    said = client.put(open_)
                    failed += [(*r, s) for r, s in zip(open_, said, strict=True) if s not in (None, "retry")]
                    open_ = [r for r, s in zip(open_, said, strict=True) if s == "retry"]
                    if not open_:
                        break
                    time.sleep(pause_s)
                failed += [(*r, f"not taken in {tries} tries") for r in open_]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in failed], pa.string()) for i in range(3)], ["key", "value", "error"])

    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).mapInArrow(run, "key string, value string, error string")


def record_creates(df: DataFrame) -> DataFrame:
    """(key, value) of records to create: no id, all fields as JSON."""
    return df.select(F.lit(None).cast("string").alias("key"), encode(F.struct(*df.columns)).alias("value"))


def record_upserts(df: DataFrame, id_field: str) -> DataFrame:
    """(key, value) of records: the external id, and the other fields as JSON."""
    return df.select(F.col(id_field).cast("string").alias("key"), encode(F.struct(*[c for c in df.columns if c != id_field])).alias("value"))
