"""Intermediate results: named row sets that are computed once and read by later steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_places: dict[tuple[str, str], str] = {}
_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; below a temporary one where that is unset and all runs on one machine (tests)."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _roots:
            _roots[app] = tempfile.mkdtemp(prefix="shardloom-")
            atexit.register(shutil.rmtree, _roots[app], ignore_errors=True)
        root = _roots[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def create_intermediate_result(name: str, df: DataFrame, most_bytes: int | None = None) -> int:
    """Write df under a name; the number of rows written. A result of more than most_bytes, as files, is removed and raises ValueError."""
    spark = df.sparkSession
    path = shared_folder(spark, "result")
    df.write.parquet(path)
    if most_bytes is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if (size := files.getContentSummary(where).getLength()) > most_bytes:
            files.delete(where, True)
            raise ValueError(f"the intermediate result {name} has {size} bytes, more than {most_bytes}")
    _places[spark.sparkContext.applicationId, name] = path
    return spark.read.parquet(path).count()


def read_intermediate_result(spark: SparkSession, name: str) -> DataFrame:
    """The rows written under a name."""
    return spark.read.parquet(_places[spark.sparkContext.applicationId, name])


def read_intermediate_results(spark: SparkSession, names: list[str]) -> DataFrame:
    """The rows of several results of one schema."""
    return spark.read.parquet(*[_places[spark.sparkContext.applicationId, n] for n in names])


def broadcast_intermediate_result(spark: SparkSession, name: str, most_bytes: int = 64 << 20) -> DataFrame:
    """A result with a broadcast hint if its files are small enough, without one if they aren't."""
    from shardloom.operators.joins import estimated_bytes

    df = read_intermediate_result(spark, name)
    return F.broadcast(df) if estimated_bytes(df) <= most_bytes else df


def partition_query_result(df: DataFrame, key: str, bounds: list, path: str) -> DataFrame:
    """Write df in fragments by ranges of key (bounds: each fragment's largest value but the last's); fragment, n."""
    part = sum(((F.coalesce(F.col(key) > b, F.lit(False))).cast("int") for b in sorted(bounds)), F.lit(0))
    df.withColumn("fragment", part).write.partitionBy("fragment").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("fragment").agg(F.count("*").alias("n"))


def read_fragments(spark: SparkSession, path: str, bounds: list, least, most) -> DataFrame:
    """The fragments of a partitioned result that can hold keys from least to most; the files of others aren't listed as input."""
    of = lambda x: sum(x > b for b in bounds)
    return spark.read.parquet(path).where(F.col("fragment").between(of(least), of(most))).drop("fragment")
