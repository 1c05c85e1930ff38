"""Tables partitioned by time: ranges that are there, ranges that are missing, old ranges dropped."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part_start"


def partition_ranges(start: datetime, end: datetime, step: timedelta) -> list[tuple[datetime, datetime]]:
    """Ranges [from, to) of a step, aligned to multiples of it since 1970, that cover start to end."""
    if step <= timedelta(0):
        raise ValueError("the interval must be positive")
    zero = datetime(1970, 1, 1)
    at = zero + (start - zero) // step * step
    out = []
    while at < end:
        out.append((at, at + step))
        at += step
    return out


def write_partitioned(df: DataFrame, path: str, column: str, step: timedelta, mode: str = "errorifexists") -> None:
    """Store df in a folder for each range of column. Rows without a time aren't in any range; they raise."""
    seconds = int(step.total_seconds())
    ts = F.col(column).cast("timestamp")
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)
    checked = F.when(ts.isNull(), F.raise_error(F.lit("no partition for a null time")).cast("string")).otherwise(F.date_format(start, "yyyy-MM-dd'T'HH-mm-ss"))
    df.withColumn(PART, checked).write.mode(mode).partitionBy(PART).option("compression", "zstd").parquet(path)


def time_partitions(spark: SparkSession, path: str, step: timedelta) -> DataFrame:
    """partition, from_value, to_value of each folder: the view of all partitions."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory() and f.getPath().getName().startswith(f"{PART}="))
    rows = [(n, t := datetime.strptime(n.partition("=")[2], "%Y-%m-%dT%H-%M-%S"), t + step) for n in names]
    return spark.createDataFrame(rows, "partition string, from_value timestamp_ntz, to_value timestamp_ntz")


def missing_partition_ranges(spark: SparkSession, path: str, step: timedelta, to: datetime, start: datetime) -> DataFrame:
    """from_value, to_value of the ranges from start to the time to that have no folder yet."""
    wanted = spark.createDataFrame(partition_ranges(start, to, step), "from_value timestamp_ntz, to_value timestamp_ntz")
    return wanted.join(time_partitions(spark, path, step).select("from_value"), "from_value", "left_anti").select("from_value", "to_value")


def create_time_partitions(spark: SparkSession, path: str, step: timedelta, to: datetime, start: datetime) -> bool:
    """Make a folder for each missing range; False if none was missing."""
    rows = missing_partition_ranges(spark, path, step, to, start).collect()
    jvm = spark.sparkContext._jvm
    for r in rows:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{PART}={r.from_value:%Y-%m-%dT%H-%M-%S}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return bool(rows)


def drop_old_time_partitions(spark: SparkSession, path: str, step: timedelta, older_than: datetime) -> int:
    """Delete the folders whose ranges end at older_than or before; how many."""
    old = time_partitions(spark, path, step).where(F.col("to_value") <= F.lit(older_than).cast("timestamp_ntz")).collect()
    jvm = spark.sparkContext._jvm
    for r in old:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{r.partition}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(old)


def read_range(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """Rows of the partitions whose start lies in [start, end): only their folders are read."""
    lo, hi = (f"{t:%Y-%m-%dT%H-%M-%S}" for t in (start, end))
    return spark.read.option("basePath", path).parquet(path).where((F.col(PART).cast("string") >= lo) & (F.col(PART).cast("string") < hi))


def _rename(spark: SparkSession, old: str, new: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{old} couldn't be moved to {new}")


def _folder(start: datetime) -> str:
    return f"{PART}={start:%Y-%m-%dT%H-%M-%S}"


def detach_partition(spark: SparkSession, path: str, start: datetime, to: str) -> None:
    """Move a partition's folder out of the table, to the folder to."""
    _rename(spark, f"{path}/{_folder(start)}", to)


def attach_partition(spark: SparkSession, path: str, start: datetime, source: str) -> None:
    """Make a folder of files the partition that begins at start."""
    _rename(spark, source, f"{path}/{_folder(start)}")


def time_partition_range(partition: str, step: timedelta) -> tuple[datetime, datetime]:
    """From a folder's name to its range."""
    start = datetime.strptime(partition.rstrip("/").rpartition("=")[2], "%Y-%m-%dT%H-%M-%S")
    return start, start + step


def set_old_partitions_codec(spark: SparkSession, path: str, step: timedelta, older_than: datetime, codec: str) -> int:
    """Rewrite the partitions whose ranges end at older_than or before with another codec; how many.

    A partition is written aside, then its folder is exchanged by two renames.
    """
    old = [r.partition for r in time_partitions(spark, path, step).where(F.col("to_value") <= F.lit(older_than).cast("timestamp_ntz")).collect()]
    jvm = spark.sparkContext._jvm
    for name in old:
        aside, gone = f"{path}/_new-{name}", f"{path}/_old-{name}"
        spark.read.parquet(f"{path}/{name}").write.mode("overwrite").option("compression", codec).parquet(aside)
        _rename(spark, f"{path}/{name}", gone)
        _rename(spark, aside, f"{path}/{name}")
        where = jvm.org.apache.hadoop.fs.Path(gone)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(old)
