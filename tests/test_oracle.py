"""Every registered query with an oracle equals its DuckDB SQL (small scale here; the
driver checks sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from babelqa.plans.queries import ORACLE, QUERIES
from conftest import SF001
from scripts.oracle_check import TABLES, rows_of

ORACLES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "StringType": "VARCHAR",
                 "DoubleType": "DOUBLE", "BooleanType": "BOOLEAN"}


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF001)
    rel = con.sql(E.oracle_sql()[name])
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__) for f in sdf.schema.fields} == types
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(dcols, res.fetchall())


def test_every_query_of_the_library_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
