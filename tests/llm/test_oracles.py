"""Queries against their SQL."""

import duckdb
import pytest

from probefleet.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = duck.execute(ORACLES[name])
    columns = sorted(x[0] for x in want.description)
    want = sorted(map(str, want.df()[columns].itertuples(index=False, name=None)))
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got.toPandas()[columns].itertuples(index=False, name=None))) == want


def test_every_operator_has_its_query():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert numbers == list(range(1, len(numbers) + 1))
