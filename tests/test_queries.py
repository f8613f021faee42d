"""Every registered query with SQL gives the same rows as DuckDB; the others give rows."""

import datetime
import decimal
import os

import duckdb
import pytest

from trackworks.plans import load_all

REGISTRY = load_all()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = REGISTRY.queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in REGISTRY.sql:
        assert rows
        return
    rel = duck.sql(REGISTRY.sql[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
