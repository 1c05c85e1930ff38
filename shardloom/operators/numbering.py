"""Consecutive numbers for the rows of a table, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.sources.intermediate import shared_folder

#: monotonically_increasing_id holds the partition above this many bits and the place in it below.
PLACE_BITS = 33


def number_rows(df: DataFrame, order_by: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """df with consecutive numbers in the order of columns, nulls first; rows equal in these are numbered in an order of their own.

    Rows are dealt by ranges, sorted and stored with their place in the partition; the partitions' counts, one row
    each, tell where the numbers of each begin. A hash of the row ends the key, so many equal keys don't meet in one task.
    """
    at, part, rows, first = "_at", "_part", "_rows", "_first"
    key = [*[F.col(c) for c in order_by], F.xxhash64(*df.columns)]
    path = shared_folder(df.sparkSession, "numbered")
    df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn(at, F.monotonically_increasing_id()).write.parquet(path)
    told = df.sparkSession.read.parquet(path).withColumn(part, F.shiftright(at, PLACE_BITS))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = told.groupBy(part).agg(F.count("*").alias(rows)).select(part, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(first))
    place = F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return told.join(F.broadcast(starts), part).select((F.col(first) + place + start).alias(name), *df.columns)
