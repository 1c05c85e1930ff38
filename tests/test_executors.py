"""Queries that went wrong only where executors are processes of their own: two of them, on the smallest tables."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from shardloom.plans import registry
from tests.compare import SF, duck, rows

REPO = Path(__file__).resolve().parents[1]
NAMES = ["lateral_topn", "foreign_scan"]
#: Prints one JSON line for each query: its name, and columns and rows or the error.
SCRIPT = """
import json, sys
from pyspark.sql import SparkSession
from shardloom.plans import registry

where, sf, *names = sys.argv[1:]
conf = {
    "spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
    "spark.checkpoint.dir": f"file://{where}/shared", "spark.sql.warehouse.dir": f"{where}/warehouse", "spark.local.dir": f"{where}/local",
    "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in names:
    try:
        df = registry.queries()[name](spark, sf)
        print("RESULT", json.dumps([name, df.columns, [list(r) for r in df.collect()]]), flush=True)
    except Exception as e:
        print("RESULT", json.dumps([name, None, str(e)[:2000]]), flush=True)
spark.stop()
"""

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def results(tmp_path_factory):
    where = tmp_path_factory.mktemp("executors")
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(where), SF, *NAMES], cwd=where, env={**os.environ, "PYTHONPATH": str(REPO)}, capture_output=True, text=True, timeout=300)
    told = [json.loads(line.partition(" ")[2]) for line in done.stdout.splitlines() if line.startswith("RESULT ")]
    assert len(told) == len(NAMES), done.stderr[-3000:]
    return {name: (columns, found) for name, columns, found in told}


@pytest.mark.parametrize("name", NAMES)
def test_executors_give_the_results_of_sql(results, name):
    columns, found = results[name]
    assert columns, found
    want = duck().execute(registry.oracle_sql()[name])
    assert rows(columns, found) == rows([d[0] for d in want.description], want.fetchall())
