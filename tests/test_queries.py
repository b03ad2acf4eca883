"""Every registered query against its DuckDB twin (the driver's check):
same column names, same column types, and the same rows with exact values
(floats compared bit for bit). Runs on sf0.001 by default; set
EVENTLENS_QUERY_SF to another table folder to check a larger scale."""
import math
import os

import duckdb
import pytest

from helpers import SF_SMALL
from eventlens.plans.bindings import TABLES
from eventlens.plans.oracle import ORACLE
from eventlens.plans.queries import QUERIES

SF = os.environ.get("EVENTLENS_QUERY_SF", SF_SMALL)
SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                 "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLE[name])
    dtypes = {c[0]: str(c[1]) for c in rel.description}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == dtypes
    assert _rows(df.columns, df.collect()) == _rows(list(dtypes), rel.fetchall())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
