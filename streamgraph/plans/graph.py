"""Pipelines: sources and operators joined by named streams, compiled to one DataFrame per stream.

A stream that several producers name is the union of them. A stream that several
operators read goes whole to each of them, unless they are declared with ``compete``: then they share its rows. The
same definition runs on bounded frames and on streams; Catalyst sees one plan per sink.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import functions as fn
from ..operators import routing, rows, stats
from ..operators.routing import Route


@dataclass
class Step:
    name: str
    function: Callable[[DataFrame], DataFrame]
    reads: str
    writes: str | None
    route: Route
    parallelism: int | None
    key: str | None
    compete: bool


class Pipeline:
    """Subclass and override ``definition``, or call ``source``, ``operator`` and ``sink`` from outside."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._sources: dict[str, list[DataFrame]] = {}
        self._steps: list[Step] = []
        self._sinks: list[tuple[str, str, Callable]] = []
        self._built: dict[str, DataFrame] = {}
        self._started: dict[str, StreamingQuery] = {}

    def definition(self) -> None:
        """Declares the graph; called once by ``build``."""

    def source(self, frame: DataFrame | Callable[[SparkSession], DataFrame], stream: str) -> Pipeline:
        self._sources.setdefault(stream, []).append(frame(self.spark) if callable(frame) and not isinstance(frame, DataFrame) else frame)
        return self

    def operator(self, function: Callable[[DataFrame], DataFrame], reads: str, writes: str, route: Route = Route.RANDOM, parallelism: int | None = None, key: str | None = None, compete: bool = False) -> Pipeline:
        """``parallelism`` deals the input anew (a shuffle); without it rows stay where they are."""
        if isinstance(route, str):
            route = Route(route)
        self._steps.append(Step(getattr(function, "__name__", "operator"), function, reads, writes, route, parallelism, key, compete))
        return self

    def sink(self, function: Callable[[DataFrame], object], reads: str, name: str | None = None) -> Pipeline:
        """``function`` gets the stream's frame; for a stream it returns the started query."""
        self._sinks.append((name or f"sink-{len(self._sinks)}", reads, function))
        return self

    def streams(self) -> list[str]:
        return sorted({*self._sources, *(s.writes for s in self._steps if s.writes)})

    def build(self) -> dict[str, DataFrame]:
        """Every named stream as a frame; names without a producer and cycles are errors."""
        if not self._built:
            if not self._sources and not self._steps:
                self.definition()
            for name in self.streams():
                self._stream(name, ())
            for _, reads, _ in self._sinks:
                self._stream(reads, ())
        return self._built

    def _stream(self, name: str, above: tuple[str, ...]) -> DataFrame:
        if name in above:
            raise ValueError(f"stream {name} feeds itself: {' -> '.join((*above, name))}")
        if name not in self._built:
            parts = [*self._sources.get(name, [])]
            parts += [self._apply(s, (*above, name)) for s in self._steps if s.writes == name]
            if not parts:
                raise ValueError(f"stream {name} has no producer")
            self._built[name] = rows.fan_in(*parts)
        return self._built[name]

    def _apply(self, step: Step, above: tuple[str, ...]) -> DataFrame:
        df = self._stream(step.reads, above)
        rivals = [s for s in self._steps if s.reads == step.reads and s.compete]
        if step.compete and len(rivals) > 1:
            df = routing.competing(df, len(rivals), step.key or df.columns[0])[next(i for i, s in enumerate(rivals) if s is step)]
        if step.route is Route.ALL:
            df = routing.routed(df, step.route, step.parallelism or 1)
        elif step.parallelism:
            df = routing.routed(df, step.route, step.parallelism, step.key)
        return step.function(df)

    def run(self) -> dict[str, object]:
        """Hands each sink its stream; started queries are kept for ``status`` and ``stop``."""
        self.build()
        out = {name: function(self._built[reads]) for name, reads, function in self._sinks}
        self._started |= {name: q for name, q in out.items() if hasattr(q, "awaitTermination")}
        return out

    @property
    def queries(self) -> list[StreamingQuery]:
        return list(self._started.values())

    def status(self) -> list[dict]:
        return [{"name": q.name, "id": str(q.id), "active": q.isActive, "status": q.status, "last": q.lastProgress} for q in self.queries]

    def status_frame(self, control: DataFrame, trees: DataFrame, processes: DataFrame, now: Column) -> DataFrame:
        """One row per process (process, name): its state, what waits, averages, percentile, the last failures and the minutes' counts.

        control: progress events; trees: as ``tracking.folded`` gives them. Every part is an aggregate by process, so the rows are as many as processes.
        """
        events = control.withColumnRenamed("process_name", "process")
        recent = events.where((F.col("ts") <= now) & (F.col("ts") > now - F.expr("INTERVAL 3 MINUTES"))).groupBy("process").agg(F.count("*").alias("recent"))
        minutes = stats.minute_histogram(events, "process", "ts", now, error_count="is_fail", success_count="not is_fail")
        bars = minutes.groupBy("process").agg(F.sort_array(F.collect_list(F.struct("minute", "error_count", "success_count"))).alias("minutes"))  # 60 at most
        failures = stats.recent(events.where("is_fail"), "process", [F.desc("ts"), F.desc("seq")])
        last = failures.groupBy("process").agg(F.sort_array(F.collect_list(F.struct("rank", "ts", "root_id", "error_message"))).alias("failures"))  # 20 at most
        out = processes.select("process", "name").join(stats.waiting(trees, processes), "process", "left")
        for part in (stats.averages(events, "process"), stats.rank_percentile(stats.frequencies(events, "process"), "process"), recent, bars, last):
            out = out.join(part, "process", "left")
        out = out.na.fill(0, ["waiting", "recent"])
        return out.withColumn("state", fn.state(F.col("waiting"), F.col("recent"))).withColumn("seconds_left", fn.seconds_left(F.col("avg_time_taken_s"), F.col("waiting")))

    def wait(self, timeout: float | None = None, restarts: int = 0, pause_s: float = 10.0) -> None:
        """Returns when all queries have ended, or after ``timeout`` seconds.

        A query that dies is started again from its checkpoint by its own sink after ``pause_s``, up to ``restarts`` times; the others go on. After
        that the others are stopped, and its error is raised.
        """
        until = None if timeout is None else time.monotonic() + timeout
        left = dict.fromkeys(self._started, restarts)
        while any(q.isActive or q.exception() for q in self._started.values()):
            for name, query in list(self._started.items()):
                if query.isActive or not query.exception():
                    continue
                if not left[name]:
                    self.stop()
                    raise query.exception()
                left[name] -= 1
                time.sleep(pause_s)
                _, reads, function = next(s for s in self._sinks if s[0] == name)
                self._started[name] = function(self._built[reads])
            if until is not None and time.monotonic() >= until:
                return
            time.sleep(0.1)

    def stop(self) -> None:
        for q in self.queries:
            if q.isActive:
                q.stop()

    def explain(self, names: Sequence[str] = ()) -> None:
        for name, df in self.build().items():
            if not names or name in names:
                print(f"== {name}")
                df.explain("formatted")
