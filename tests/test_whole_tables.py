"""Statements, windows and functions over whole tables, against the oracle, on tables larger than the smallest ones."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from shardloom.plans import registry
from tests.compare import rows

SF = "/root/testdata/sf0.01"
WHOLE = sorted(n for n in registry.queries() if n.startswith(("dml_", "win_", "corr_", "quantified_")))
#: One row of these for each row of the table.
ALL_ROWS = {"dml_update": "orders", "win_row_number": "orders", "str_case": "part", "date_trunc": "orders", "json_field": "events", "join_range_repartition": "orders", "copy_csv": "customer", "corr_scalar": "customer"}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table_matches_oracle(spark, other, name):
    got = registry.queries()[name](spark, SF)
    found = [tuple(r) for r in got.collect()]
    want = other.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert rows(got.columns, found) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(ALL_ROWS))
def test_no_row_is_left_out(spark, name):
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{ALL_ROWS[name]}.parquet").count()


def test_no_query_takes_a_slice_of_ids():
    known = registry.oracle_sql()
    cut = [n for n, text in known.items() if n.startswith(("dml_", "win_")) and any(x in text for x in ("o_orderkey < 3000", "o_custkey < 200", "o_custkey < 300 ORDER"))]
    assert not cut
