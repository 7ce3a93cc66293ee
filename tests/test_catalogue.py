"""Every query of the catalogue against its SQL in DuckDB, names, types and values."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from streamgraph.plans import catalogue

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return x.isoformat() if isinstance(x, datetime.datetime) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    result = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(value(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(map(value, r)) for r in result.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["recent_failures_top20"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_last_write_wins_needs_no_window(spark):
    plan = catalogue.QUERIES["upsert_last_wins"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_evicted_processes_rounds_as_its_sql(spark, tmp_path, zone):
    """Halves go to the even second, either side of the cutoff and of 1970, in any session's time zone."""
    times = "2024-01-28 13:16:50.465735|2024-01-28 13:16:50.5|2024-01-28 13:16:51.5|2024-01-29 03:54:47.905753|2024-01-29 12:29:59.499999|2024-01-29 12:29:59.5|2024-01-29 12:30:00|2023-03-12 02:30:00.7|1969-12-31 23:59:57.5|1969-12-31 23:59:58.4"
    rows = ", ".join(f"({i}, TIMESTAMP '{t}'), ({i}, TIMESTAMP '{t}' - INTERVAL 1 HOUR)" for i, t in enumerate(times.split("|")))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}, (99, NULL), (NULL, TIMESTAMP '2024-01-28 00:00:00.6')) t(user_id, ts)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {tuple(r) for r in catalogue.QUERIES["evicted_processes"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == set(con.execute(catalogue.ORACLES["evicted_processes"]).fetchall()) and len(got) == 9


@pytest.mark.parametrize("name", ["iso_duration_roundtrip", "iso_duration_parse", "duration_texts"])
def test_durations_are_matched_once(spark, name):
    """The pattern is in the plan once, so no row's text is matched for each of its numbers, in whatever operator the column stands."""
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") == 1 and plan.count("split(") == 1
