"""Every registered query against its SQL oracle, and what its plan must not contain."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from probefleet.plans.oracles import oracles
from probefleet.plans.queries import registry

DATA = os.environ.get("PROBEFLEET_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, ORACLES = registry(), oracles()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def normal(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[kind] for c, kind in df.dtypes} == kinds
    order = sorted(columns)
    got = sorted([normal(row[c]) for c in order] for row in df.collect())
    want = sorted([normal(row[columns.index(c)]) for c in order] for row in result.fetchall())
    assert len(got) == len(want) and got == want
    assert got


BATCH = sorted(name for name in QUERIES if not name.startswith("stream_"))


@pytest.mark.parametrize("name", BATCH)
def test_plan_stays_on_spark(spark, name):
    """No Python worker, no product of rows, no window or sort over everything in one task."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "NestedLoop", "ArrowEval", "BatchEvalPython", "MapInPandas", "SinglePartition"):
        assert unwanted not in plan, unwanted


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["records_produced"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "user_id" in schema and "event_type" in schema
    assert "props" not in schema and "value" not in schema


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cluster_id", "client_id", "le", "bucket_count", "sum", "count", "tick", "percentage"]
    assert df.count() > 0
