"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from planloom.plans import all_queries, all_sql

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(show(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    result = entry.queries()[name](spark, DATA)
    answer = db.execute(entry.oracle_sql()[name])
    expected = _rows([d[0] for d in answer.description], answer.fetchall())
    assert _rows(result.columns, result.collect()) == expected


def test_every_query_has_sql():
    assert all_queries().keys() == all_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", ["constraint_rows", "distance_edges"])
def test_records_are_decoded_once(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("pythonUDF" in node for node in plan.split("Filter ")[1:] for node in [node.split("+-")[0]])
