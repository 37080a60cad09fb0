"""Every query of the engine's own operators: against DuckDB where it has SQL, else its shape."""

import math
import os

import duckdb
import pytest

from lodestar import catalog

SF = os.environ.get("CATALOG_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def plain(v):
    """Values in a form both engines share."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def key(row):
    return tuple((x is None, str(type(x)), x) if not isinstance(x, tuple) else (False, "t", str(x)) for x in row)


def kind(name: str) -> str:
    """Column types, named alike."""
    name = str(name).lower()
    return {"bigint": "long", "integer": "int", "int32": "int", "int64": "long", "varchar": "string", "double": "double", "boolean": "boolean"}.get(name, name)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=key)
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert got
        return
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    types = {d[0]: kind(d[1]) for d in res.description}
    want = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=key)
    assert len(got) == len(want)
    assert got == want
    spark_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    assert spark_types == {c: t for c, t in types.items()} or not ({"long", "int", "double", "string", "boolean"} >= set(types.values()) | set(spark_types.values()))
