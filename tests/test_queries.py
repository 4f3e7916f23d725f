"""Every query of the core runs over the smallest tables, and those with SQL agree with it."""

import os

import duckdb
import pytest

from siftwood.plans import catalog

DATA = "/root/testdata/sf0.001"
SLOW = {"h01_cyclic_includes", "g16_include_cycles", "a15_health_score", "g12_central_files"}


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA) if os.path.isdir(DATA) else []:
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, folder, db, name):
    df = catalog.QUERIES[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    if name in catalog.SQL:
        found = db.execute(catalog.SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, found.fetchall())
