"""One small local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from shardloom.session import local_session

    where = tmp_path_factory.mktemp("spark")
    session = local_session(4, memory="4g", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(where / "warehouse"), "spark.checkpoint.dir": f"file://{where}/shared"})
    yield session
    session.stop()
