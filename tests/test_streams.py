from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from streamgraph import schema
from streamgraph.operators import aggregates, rows, tracking
from streamgraph.operators.routing import Route
from streamgraph.plans.graph import Pipeline
from streamgraph.sinks import messages
from streamgraph.sinks.database import Database
from streamgraph.sources import brokers, services, tables
from streamgraph.sources.client import ClientSource
from streamgraph.streaming import batches, state, tracker
from streamgraph.streaming.monitor import Monitor

from . import fakes
from .conftest import DATA


def drained(df, tmp_path, mode="append", name="out"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def polled(df, tmp_path, name, n):
    """Rows of a query with timers, which never runs out of batches: until there are ``n``."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="0 seconds").start()
    try:
        for _ in range(60):
            if q.awaitTermination(1) or df.sparkSession.table(name).count() >= n:
                break
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def split(df):
    return rows.split_words(df, "content")


def count(df):
    return aggregates.counts(df, "word")


class WordCount(Pipeline):
    def definition(self):
        self.source(lambda s: s.createDataFrame([("a b",), ("b",)], "content string"), "sentence")
        self.source(lambda s: s.createDataFrame([("b c",)], "content string"), "sentence")
        self.operator(split, "sentence", "word", parallelism=2)
        self.operator(count, "word", "count", route=Route.HASH, key="word", parallelism=2)
        self.sink(lambda df: {r["word"]: r["n"] for r in df.collect()}, "count", "result")


def test_pipeline_fan_in_and_out(spark):
    assert WordCount(spark).run()["result"] == {"a": 1, "b": 3, "c": 1}
    shared = Pipeline(spark).source(spark.range(100).toDF("id"), "in")
    for i in range(2):
        shared.operator(lambda df: df, "in", f"out{i}", compete=True).operator(lambda df: df, "in", f"all{i}")
    built = shared.build()
    assert built["all0"].count() == built["all1"].count() == 100
    assert 0 < built["out0"].count() < 100 and built["out0"].unionByName(built["out1"]).distinct().count() == 100


def test_pipeline_rejects_cycles_and_gaps(spark):
    with pytest.raises(ValueError, match="feeds itself"):
        Pipeline(spark).operator(split, "a", "a").build()
    with pytest.raises(ValueError, match="no producer"):
        Pipeline(spark).operator(split, "nowhere", "b").build()


def test_streamed_word_count_equals_the_bounded_one_and_survives_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a b",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/one")
    stream = lambda: spark.readStream.schema("text string").parquet(f"{tmp_path}/in/*")
    seen = []
    run = lambda: batches.each_batch(batches.word_counts(stream()), lambda df, n: seen.append({r["word"]: r["n"] for r in df.collect()}), f"file://{tmp_path}/cp", mode="update").awaitTermination(120)
    run()
    spark.createDataFrame([("b c",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/two")
    run()
    assert [x for x in seen if x] == [{"a": 1, "b": 1}, {"b": 2, "c": 1}]


def test_tracker_equals_the_bounded_fold(spark, tmp_path):
    events = [("s", "1", 5, False), ("s", "1", 9, False), ("s", "1", 5, False), ("s", "1", 9, False), ("s", "2", 4, False), ("s", "3", 1, True), ("t", "1", 2, False), ("t", "1", 2, False)]
    made = [(i, None, r, p, 0, a, f, "fail" if f else "ack", "w", None, None, "w", "boom" if f else None, None) for i, (p, r, a, f) in enumerate(events)]
    df = spark.createDataFrame(made, schema.CONTROL)
    df.coalesce(1).write.parquet(f"{tmp_path}/control")
    got = polled(tracker.outcomes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/control")), tmp_path, "outcomes", 3)
    bounded = {(r["producer"], r["root_id"]): r["status"] for r in tracking.folded(df).where("status <> 'waiting'").collect()}
    assert {(r["producer"], r["root_id"]): r["status"] for r in got} == bounded == {("s", "1"): "success", ("s", "3"): "failed", ("t", "1"): "success"}


def test_tracker_times_out(spark, tmp_path):
    df = spark.createDataFrame([(0, None, "1", "s", 0, 5, False, "new_msg", "w", None, None, "w", None, None)], schema.CONTROL)
    df.coalesce(1).write.parquet(f"{tmp_path}/control")
    stream = tracker.outcomes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/control"), timeout_ms=1)
    assert [r["status"] for r in polled(stream, tmp_path, "late", 1)] == ["timeout"]


def test_sharded_source_reads_limits_commits_and_resumes(spark, tmp_path):
    spark.dataSource.register(ClientSource)
    for s in "ab":
        (tmp_path / f"s{s}.jsonl").write_text("".join(json.dumps([f"k{i}", f"{s}{i}"]) + "\n" for i in range(5)))
    options = {"factory": "tests.fakes:FileShards", "path": str(tmp_path), "limit": "2", "start": "earliest"}
    assert spark.read.format("client").options(**options).load().count() == 10
    monitor = Monitor()
    spark.streams.addListener(monitor)
    seen: list[list[str]] = []

    def run():
        stream = spark.readStream.format("client").options(**options).load()
        q = batches.each_batch(stream, lambda df, n: seen.append(sorted(r["root_id"] for r in df.collect())), f"file://{tmp_path}/cp", seconds=0.1)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert sorted(x for part in seen for x in part) == sorted(f"s{s}-{i}" for s in "ab" for i in range(5))
    assert max(map(len, seen)) == 4  # two records a shard and batch
    assert json.loads((tmp_path / "commits.jsonl").read_text().splitlines()[0]) == {"sa": 2, "sb": 2}
    n = len(seen)
    with (tmp_path / "sa.jsonl").open("a") as f:
        f.write(json.dumps(["k", "new"]) + "\n")
    run()
    assert [x for x in seen[n:] if x][-1] == ["sa-5"]
    assert monitor.frame(spark).where("input_rows > 0").count() > 0 and not monitor.errors
    spark.streams.removeListener(monitor)


def test_queue_service_and_record_sources(spark, tmp_path):
    spark.dataSource.register(ClientSource)
    path = tmp_path / "queue.json"
    path.write_text(json.dumps([[f"r{i}", json.dumps({"g": i % 3})] for i in range(25)]))
    read = lambda name, **o: spark.read.format("client").options(factory=f"tests.fakes:{name}", **o).load()
    assert {r["key"] for r in read("queue", path=str(path), json_group_key="g").collect()} == {"0", "1", "2"}
    invoice = read("invoices").first()
    assert invoice["uuid"] == "u1" and invoice["total_in_cents"] == 5 and len(read("invoices").columns) == 13
    assert tuple(read("accounts").first()) == ("c", "a")
    assert json.loads(read("sobjects").first()["content"]) == {"Id": "1", "Name": "n"}
    frames = spark.createDataFrame([('{"data": {"sobject": {"Id": "7", "a": 1}}}',), ('{"data": {}}',), ("x",)], "frame string")
    assert [r["key"] for r in services.sobject_updates(frames).collect()] == ["7"]


def drive(spark, options, tmp_path, name, batches_=1):
    """Batches of a client stream that never ends, until there are so many with rows."""
    seen = []
    stream = spark.readStream.format("client").options(**options).load()
    q = batches.each_batch(stream, lambda df, n: seen.append([tuple(r) for r in df.collect()]), f"file://{tmp_path}/{name}", seconds=0.1)
    try:
        for _ in range(300):
            if q.awaitTermination(0.1) or len([x for x in seen if x]) >= batches_:
                break
    finally:
        q.stop()
    return [x for x in seen if x]


def test_queue_as_a_stream_keeps_bodies_out_of_the_offsets(spark, tmp_path):
    spark.dataSource.register(ClientSource)
    path = tmp_path / "queue.json"
    path.write_text(json.dumps([[f"r{i}", json.dumps({"g": "body-text"})] for i in range(25)]))
    seen = drive(spark, {"factory": "tests.fakes:queue", "path": str(path), "most": "10", "json_group_key": "g"}, tmp_path, "cp", 3)
    assert sorted(r[0] for part in seen for r in part) == sorted(f"r{i}" for i in range(25)) and [len(x) for x in seen] == [10, 10, 5]
    assert all("body-text" not in p.read_text() for p in (tmp_path / "cp" / "offsets").glob("[0-9]*"))
    deleted = path.with_suffix(".deleted").read_text().split()
    assert {f"r{i}" for i in range(10)} <= set(deleted)


def test_a_queue_is_created_and_failed_receipts_stay(tmp_path):
    q = fakes.queue({"path": str(tmp_path / "new.json")})
    assert q.handle() == "words" and (tmp_path / "new.json").read_text() == "[]"
    (tmp_path / "new.json").write_text(json.dumps([["a", "x"], ["b", "y"]]))
    assert list(q.read("batch1", None, None)) == [("a", None, "x"), ("b", None, "y")] == list(q.read("batch1", None, None))
    q.redeliver("batch1", ["b"])
    q.commit({"queue": "batch1"})
    assert (tmp_path / "new.deleted").read_text().split() == ["a"]


def test_start_positions(tmp_path):
    for s in "ab":
        (tmp_path / f"s{s}.jsonl").write_text("".join(json.dumps(["k", f"{s}{i}"]) + "\n" for i in range(5)))
    at = lambda **o: fakes.FileShards({"path": str(tmp_path), **o}).earliest()
    assert at() == {"sa": 5, "sb": 5} and at(start="earliest") == {"sa": 0, "sb": 0} and at(start='{"sa": 2}') == {"sa": 2, "sb": 5}
    assert fakes.FileShards({"path": str(tmp_path)}).lag({"sa": 3, "sb": 5}) == 2


def test_services_are_polled_once_a_period(spark, tmp_path, monkeypatch):
    spark.dataSource.register(ClientSource)
    listing = fakes.invoices({})
    monkeypatch.setattr(services.Polled, "clock", staticmethod(lambda: 7200.0))
    assert listing.latest({}) == {"invoices": 2} and fakes.sobjects({}).latest({}) == {"query": 4}
    monkeypatch.undo()
    assert [len(x) for x in drive(spark, {"factory": "tests.fakes:accounts"}, tmp_path, "accounts")] == [1]
    frames = drive(spark, {"factory": "tests.fakes:pushed"}, tmp_path, "pushed")
    assert [r[0] for r in frames[0]] == [1, 2, 3, 4, 5]


def test_bodies_are_decoded(spark):
    records = spark.createDataFrame([("s-1", "k", '{"a": 3}'), ("s-2", None, "nope")], "root_id string, key string, content string")
    good, bad = brokers.messages(records, "a int")
    assert [(r["root_id"], r["content"]["a"]) for r in good.collect()] == [("s-1", 3)] and [r["root_id"] for r in bad.collect()] == ["s-2"]


def test_writers(spark, tmp_path, capfd):
    df = spark.createDataFrame([("a", "x"), ("b", "y" * 300_000), ("c", "z" * 1_100_000)], "key string, body string")
    query, bad = messages.kafka_write(df.where("key = 'a'"), "words", "key", "body", kind="noop", servers="h:1")
    assert query is None and bad.isEmpty()
    _, bad = messages.kafka_write(df, "words", "key", "body", kind="noop")
    assert [bytes(r["key"]) for r in bad.collect()] == [b"c"] and messages.kafka_options("words", "h:1")["topic"] == "words"
    failed = messages.queue_write(df, "key", "body", "tests.fakes:Throttled", pause_s=0)
    assert sorted((r["key"], r["error"]) for r in failed.collect()) == [("b", "over 262144 bytes"), ("c", "over 262144 bytes")]
    messages.console(df.where("key = 'a'").select("key"))
    assert json.loads(messages.record_creates(df.where("key = 'a'")).first()["value"]) == {"key": "a", "body": "x"}
    df.where("key = 'a'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = messages.console(stream, checkpoint=f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    query, _ = messages.kafka_write(stream, "words", "key", "body", checkpoint=f"file://{tmp_path}/cp2", kind="noop")
    query.processAllAvailable()
    query.stop()
    assert not query.exception()


def running_total(key, state, rows):
    total = (state[0] if state else 0) + int(rows["n"].sum())
    return (total,), rows.head(1)[["k"]].assign(total=total)


def test_user_state_survives_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda name, *r: spark.createDataFrame(r, "k string, n int").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    write("one", ("a", 1), ("a", 2), ("b", 5))
    seen = []

    def run():
        rows_ = spark.readStream.schema("k string, n int").parquet(f"{tmp_path}/in/*")
        totals = state.stateful(rows_, ["k"], running_total, "total bigint", "k string, total bigint")
        batches.each_batch(totals, lambda df, n: seen.append({r["k"]: r["total"] for r in df.collect()}), f"file://{tmp_path}/cp").awaitTermination(120)

    run()
    write("two", ("a", 4))
    run()
    assert [x for x in seen if x] == [{"a": 3, "b": 5}, {"a": 7}]


def test_a_dead_query_is_started_again(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    tries = []

    def fails_once(df, n):
        tries.append(n)
        if len(tries) == 1:
            raise RuntimeError("first try")

    def build(restarts):
        pipeline = Pipeline(spark).source(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), "in").operator(lambda df: df, "in", "out")
        pipeline.sink(lambda df: batches.each_batch(df, fails_once, f"file://{tmp_path}/cp{restarts}"), "out", "sink")
        pipeline.run()
        return pipeline

    pipeline = build(1)
    pipeline.wait(120, restarts=1, pause_s=0)
    assert tries == [0, 0] and pipeline.status()[0]["active"] is False
    tries.clear()
    with pytest.raises(Exception, match="first try"):
        build(0).wait(120)


def test_status_frame(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1, 12)
    made = [(i, t0 + timedelta(seconds=i), str(i), "s", 0, 1, kind == "fail", kind, "w-1", None, 2.0, "w-1", "boom" if kind == "fail" else None, None) for i, kind in enumerate(["new_msg", "ack", "fail", "ack"])]
    control = spark.createDataFrame(made, schema.CONTROL)
    trees = spark.createDataFrame([("waiting", "w-1"), ("success", "w-1")], "status string, destination string")
    processes = spark.createDataFrame([("w-1", "WordIntersection"), ("idle", "Idle")], "process string, name string")
    got = {r["process"]: r for r in Pipeline(spark).status_frame(control, trees, processes, F.lit(t0 + timedelta(minutes=1))).collect()}
    w = got["w-1"]
    assert (w["waiting"], w["recent"], w["state"], w["percentile"], len(w["failures"]), w["failures"][0]["error_message"]) == (1, 4, "busy", 2.0, 1, "boom")
    assert (w["minutes"][0]["error_count"], w["minutes"][0]["success_count"]) == (1, 3) and got["idle"]["state"] == "available" and got["idle"]["failures"] is None


def test_generator_and_metrics(spark, tmp_path):
    monitor = Monitor()
    spark.streams.addListener(monitor)
    stream = tables.sentences(spark, ["a b", "c"], per_second=50).observe("seen", F.count("*").alias("n"))
    got = []
    q = batches.each_batch(stream, lambda df, n: got.extend(df.collect()), f"file://{tmp_path}/cp", seconds=0.2, name="sentences")
    for _ in range(200):
        if q.awaitTermination(0.1) or len(got) >= 10 and monitor.observed.get("sentences"):
            break
    q.stop()
    spark.streams.removeListener(monitor)
    assert all(r["content"] == ["a b", "c"][int(r["root_id"]) % 2] for r in got) and len(got) >= 10
    assert "sentences" in monitor.started and "n" in monitor.observed["sentences"]["seen"]


def test_kafka_adapter(spark):
    options = brokers.kafka_options("words", "h:1", group="g")
    assert options["subscribe"] == "words" and options["maxOffsetsPerTrigger"] == "10000" and options["startingOffsets"] == "latest"
    records = spark.createDataFrame([("t", 0, 1, b"test_key", b'{"a": 3}'), ("t", 0, 2, None, b"nope")], "topic string, partition int, offset long, key binary, value binary")
    good, bad = brokers.kafka_messages(records, "a int")
    row = good.first()
    assert (row["root_id"], row["key"], row["content"]["a"]) == ("t-0-1", "test_key", 3) and bad.first()["root_id"] == "t-0-2"


def test_message_sinks(spark):
    df = spark.createDataFrame([("a", "x" * 10), ("b", "é" * 6), ("c", None)], "key string, value string")
    good, bad = messages.guarded(df, "value", 11)
    assert sorted(r["key"] for r in good.collect()) == ["a", "c"] and [r["key"] for r in bad.collect()] == ["b"]
    failed = messages.send(spark.createDataFrame([("a", "1"), ("bad", "2")], "key string, value string"), "tests.fakes:Throttled", pause_s=0)
    assert [(r["key"], r["error"]) for r in failed.collect()] == [("bad", "refused")]
    record = messages.record_upserts(spark.createDataFrame([("7", 1)], "Ext string, a int"), "Ext").first()
    assert (record["key"], json.loads(record["value"])) == ("7", {"a": 1})
    assert messages.kafka_rows(df, "key", "value").first()["value"] == '{"value":"xxxxxxxxxx"}'


def test_database_upserts(spark):
    db = Database("jdbc:derby:memory:sink;create=true", "words", {"word": "VARCHAR(64)", "n": "INT"}, key="word", order="seq")
    batch = lambda *r: spark.createDataFrame(r, "word string, n int, seq long")
    db.write(batch(("a", 1, 1), ("a", 2, 2), ("b", 1, 1)))
    db.write(batch(("b", 5, 1), ("c", 7, 1)))
    db.write(batch(("b", 5, 1), ("c", 7, 1)))
    assert {r[0]: r[1] for r in db.read(spark).collect()} == {"a": 2, "b": 5, "c": 7}
    log = Database("jdbc:derby:memory:sink;create=true", "log", {"word": "VARCHAR(64)"}, key="word", upsert=False)
    log.write(batch(("a", 1, 1), ("a", 2, 2)))
    assert log.read(spark).count() == 2
    assert not log.exists(spark, "words_staging")
    last = Database("jdbc:derby:memory:sink", "lasts", {"word": "VARCHAR(64)", "n": "INT"}, key="word", properties={"create": "true", "user": "app", "password": "x"})
    last.write(batch(("a", 1, 9), ("a", 2, 1)).coalesce(1))
    assert [tuple(r) for r in last.read(spark).collect()] == [("a", 2)]
    keys = Database("jdbc:derby:memory:sink;create=true", "keys_only", {"word": "VARCHAR(64)"}, key="word")
    keys.write(batch(("a", 1, 1)))
    keys.write(batch(("a", 1, 1)))
    assert keys.read(spark).count() == 1


def test_table_stream_can_carry_watermarks(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    spark.read.parquet(f"{DATA}/events.parquet").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    events = tables.table_stream(spark, str(tmp_path), "events").withWatermark("ts", "1 hour")
    got = drained(events.groupBy(F.window("ts", "1 day")).count(), tmp_path, "complete", "days")
    assert got.agg(F.sum("count")).first()[0] == 1000
