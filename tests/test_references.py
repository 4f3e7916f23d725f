import datetime

import pytest
from pyspark.sql import functions as F

from siftwood.operators import references as R

DAY = lambda d: datetime.datetime(2024, 1, d)


@pytest.fixture(scope="module")
def tables(spark):
    files = [(1, "r/a/x.py", DAY(2)), (1, "r/a/x.py", DAY(10)), (1, "r/a/x.py", DAY(10)), (2, "r/a/y.ts", DAY(5)), (3, "r/b/z", DAY(5)), (70000, "r/b/w.sh", DAY(5)), (None, "r/n", DAY(1))]
    symbols = [(1, 1), (2, 2), (2, 2), (3, 99), (5, 3), (None, 1)]
    tombs = [("file", 2, DAY(6)), ("file", 1, DAY(3)), ("file", 50, DAY(1)), ("symbol", 1, DAY(4)), ("symbol", 5, DAY(9)), ("symbol", 60, DAY(1)), ("symbol", 60, DAY(1)), (None, 1, DAY(1))]
    edges = [
        # edge, src, dst, kind, file, raw, seen
        (1, "file", 1, "file", 3, "includes", 1, None, DAY(8)), (2, "file", 1, "file", 2, "includes", 1, None, DAY(8)), (3, "file", 1, "file", 50, "includes", 1, None, DAY(8)), (4, "file", 1, "file", 51, "includes", 1, None, DAY(8)),
        (5, "file", 1, "file", 3, "includes", 1, None, DAY(4)), (6, "symbol", 5, "symbol", 1, "uses", 3, None, DAY(8)), (7, "symbol", 2, "symbol", 60, "uses", 2, None, DAY(8)), (8, "file", 1, "symbol", 61, "uses", 1, None, DAY(8)),
        (9, "file", 1, "package", 0, "includes", 1, None, DAY(8)), (10, "file", 1, "resource", 7, "uses", 1, None, DAY(1)), (11, "file", 1, "resource", 8, "uses", 1, None, DAY(8)), (12, "file", 1, None, None, "includes", 1, " './../b/z?q#h' ", DAY(8)),
        (13, "file", 1, None, None, "includes", 1, "./nope", DAY(8)), (14, "file", 1, None, None, "execs", 1, "../b/w", DAY(2)), (15, "file", 1, None, None, "references", 1, "./y", DAY(8)), (16, "file", 1, None, None, "includes", 1, "../../../up", DAY(8)),
        (17, "file", 1, None, None, "uses", 1, "./nope", DAY(8)), (18, "file", 1, None, None, "includes", 1, None, DAY(8)), (19, None, None, "symbol", 3, "uses", 1, None, DAY(8)), (20, "file", 70000, "file", 65536, "includes", 70000, None, None),
        (4, "file", 1, "file", 51, "includes", 1, None, DAY(8)),
    ]
    t = lambda rows, schema, *cast: spark.createDataFrame([(*r, "x") for r in rows], schema + ", reason string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in cast})
    return {
        "edges": t(edges, "edge_id long, src_type string, src_id long, dst_type string, dst_id long, kind string, file_id long, raw string, seen_at timestamp", "seen_at"),
        "files": t(files, "file_id long, rel_path string, indexed_at timestamp", "indexed_at"),
        "symbols": t(symbols, "symbol_id long, file_id long"), "resources": t([(7,), (None,)], "resource_id long"),
        "tombstones": t(tombs, "entity_type string, entity_id long, deleted_at timestamp", "deleted_at"),
    }


def test_cases(tables):
    got = {(r.edge_id, r.side, r.reason) for r in R.dangling(**tables).collect()}
    assert got == {
        (2, "dst", "deleted"), (3, "dst", "deleted"), (4, "dst", "missing"), (5, "dst", "late"), (6, "src", "deleted"), (7, "src", "deleted"), (7, "dst", "deleted"), (8, "dst", "missing"), (10, "src", "late"), (11, "dst", "missing"),
        (13, "raw", "missing"), (14, "raw", "late"), (15, "raw", "deleted"), (16, "raw", "missing"), (20, "dst", "missing"),
    }
    told = {(r.side, r.referred, r.month, r.reason): r.n for r in R.report(R.dangling(**tables)).collect()}
    assert told[("dst", "file", "2024-01", "deleted")] == 2 and told[("dst", "file", None, "missing")] == 1


def test_empty_tables(tables):
    none = {k: v.limit(0) for k, v in tables.items()}
    assert R.dangling(**none).count() == 0
    bare = {**none, "edges": tables["edges"]}
    reasons = {r.reason for r in R.dangling(**bare).where("side <> 'raw'").collect()}
    assert reasons == {"missing"}


def test_runs(spark):
    keys = spark.createDataFrame([("a", i) for i in (1, 2, 3, 5, 6, 65535, 65536, 65537)] + [("b", 5)], "type string, id long")
    got = {(r.type, r["first"], r["last"]) for r in R.runs(keys).collect()}
    assert got == {("a", 1, 3), ("a", 5, 6), ("a", 65535, 65535), ("a", 65536, 65537), ("b", 5, 5)}
    asked = spark.createDataFrame([("a", 4), ("a", 6), ("a", 7), ("b", 4), ("b", 5), ("c", 1), ("a", 65536), ("a", 65538), ("a", 4)], "type string, id long")
    assert {(r.type, r.id) for r in R.orphans(asked, keys).collect()} == {("a", 4), ("a", 7), ("b", 4), ("c", 1), ("a", 65538)}
