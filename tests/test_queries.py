"""Every registered query against its oracle in another engine, over the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from shardloom.plans import registry
from tests.compare import SF, duck, rows

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def other():
    return duck()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, other, name):
    got = registry.queries()[name](spark, SF)
    oracle = registry.oracle_sql().get(name)
    found = [tuple(r) for r in got.collect()]
    if oracle is None:
        assert got.columns
        return
    want = other.execute(oracle)
    columns = [d[0] for d in want.description]
    assert sorted(c.lower() for c in got.columns) == sorted(c.lower() for c in columns)
    assert rows(got.columns, found) == rows(columns, want.fetchall())


def test_every_query_has_a_name_and_module():
    assert len(registry.queries()) > 250
    assert set(registry.oracle_sql()) <= set(registry.queries())
