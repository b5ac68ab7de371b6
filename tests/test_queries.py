"""Every query that has an SQL twin gives the twin's rows over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import registry
from corpusloom.plans.inputs import TABLES

registry.load()


def norm(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if v is None or v is pd.NaT:
        return "None"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in v.items()) + "}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


SAMPLE = sorted(registry.ORACLES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    twin = con.sql(registry.ORACLES[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    assert sorted(tuple(norm(r[k]) for k in at) for r in twin.fetchall()) == rows


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    """The whole plan runs, and gives rows: no registered query may be right for want of input."""
    assert registry.QUERIES[name](spark, sf.replace("sf0.001", "sf0.01")).collect()
