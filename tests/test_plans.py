"""Plans are what they are meant to be: columns pruned, filters pushed down, no pairing of all with all."""

import re

import pytest

from siftwood.operators import hierarchy
from siftwood.plans import catalog
from siftwood.session import reachable
from siftwood.tables import table

#: Stated queries against all rows, block by block.
BLOCKS = {"v06_nearest"}
FAST = [n for n in catalog.QUERIES if n[0] in "tajfwhcdnsux" and n not in {"a15_health_score", "a18_packet_totals", "h01_cyclic_includes"}]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(FAST))
def test_no_query_pairs_all_with_all(spark, folder, name):
    reachable(spark)
    text = plan(catalog.QUERIES[name](spark, folder))
    if name not in BLOCKS:
        assert not re.search("CartesianProduct|NestedLoop", text), text


def columns_read(text: str, table: str) -> set[str]:
    found = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*?" + table + r"\.parquet", text)
    return {c.split("#")[0].strip() for part in found for c in part.split(",")}


def test_scans_read_the_columns_they_need(spark, folder):
    reachable(spark)
    # the hierarchy writes its blocks first, so the scan stands in the plan of its nodes
    text = plan(hierarchy._nodes(table(spark, folder, "symbols"), "symbol_id", "parent_id", "file_id", None))
    assert columns_read(text, "symbols") == {"symbol_id", "parent_id", "file_id"}
    text = plan(catalog.QUERIES["a01_fan_in"](spark, folder))
    assert "text" not in columns_read(text, "edges") and "PushedFilters: [" in text
    text = plan(catalog.QUERIES["t14_sizes_and_lines"](spark, folder))
    assert columns_read(text, "chunks") == {"file_id", "end_line"}
