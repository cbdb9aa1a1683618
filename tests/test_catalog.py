"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from partforge import catalog  # noqa: E402
from tools.check import normalized  # noqa: E402

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(queries()) and set(catalog.ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, str(TABLES))
    cursor = db.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = normalized(columns, cursor.fetchall())
    assert normalized(df.columns, df.collect()) == want
    assert want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scans_read_only_what_is_used(spark):
    query = queries()["token_statistics"](spark, str(TABLES))
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan
    assert "PushedFilters: [In(role, [assistant,user])]" in plan
    query = queries()["completed_names"](spark, str(TABLES))
    assert "ReadSchema: struct<doc_id:bigint>" in query._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry(spark).count() > 0
