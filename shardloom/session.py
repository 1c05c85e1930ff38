"""Session settings shared by the queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: ANSI (overflow and division by zero raise) is Spark's default and is kept. Sizes of
#: partitions are left to adaptive execution, so that the same plan serves 60 k rows and 100 TB.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str | None = None, memory: str = "8g", **more: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("shardloom").config("spark.driver.memory", memory)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(cpus), **more}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session, once, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="shardloom-")) / "shardloom-package.zip"
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(where))
    _shipped.add(app)
