"""Corpus queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from streamgraph.llm import queries

from ..conftest import DATA
from ..test_catalogue import value


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(value(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(value, r)) for r in result.fetchall())
