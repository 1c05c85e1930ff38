"""Join strategies by placement of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A reference table is sent to all executors only up to this size, as the optimizer estimates it.
REFERENCE_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size: file sizes or table statistics, carried through the plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def reference_join(left: DataFrame, reference: DataFrame, on, how: str = "inner", most_bytes: int = REFERENCE_BYTES) -> DataFrame:
    """Join with a reference table: broadcast if its estimated size is at most most_bytes, else an ordinary join, which shuffles."""
    small = estimated_bytes(reference) <= most_bytes
    return left.join(F.broadcast(reference) if small else reference, on, how)


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """points joined with the ranges that hold them (low <= at < high), by equal bins of a width.

    A range is listed in every bin that it touches, a point lies in one bin, so the join is on equal
    bins with a filter. Choose width near the usual length of a range. Rows with nulls don't join.
    """
    b = "_bin"
    spread = ranges.where(F.col(low) < F.col(high)).withColumn(b, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn(b, F.floor(F.col(at) / width)).join(spread, b).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop(b)


def overlap_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows whose ranges [low, high) share a value, by equal bins of a width; the frames have no column name in common.

    A range is listed in every bin that it touches. A pair is found in the bin of its larger low alone, which both
    touch, so it comes once. Choose width near the usual length of a range. Empty ranges and nulls don't join.
    """
    x, y = "_bin_a", "_bin_b"

    def spread(df: DataFrame, low: str, high: str, bin_: str) -> DataFrame:
        return df.where(F.col(low) < F.col(high)).withColumn(bin_, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))

    meet = (F.col(a_range[0]) < F.col(b_range[1])) & (F.col(b_range[0]) < F.col(a_range[1]))
    once = F.col(x) == F.floor(F.greatest(a_range[0], b_range[0]) / width)
    return spread(a, *a_range, x).join(spread(b, *b_range, y), F.col(x) == F.col(y)).where(meet & once).drop(x, y)


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int = 16, row_key: Column | None = None) -> DataFrame:
    """Inner join on key where some keys of large are hot: their rows are spread over salts, rows of small are repeated for each."""
    s = "_salt"
    spread = F.pmod(F.xxhash64(row_key if row_key is not None else F.struct(*[c for c in large.columns])), F.lit(salts))
    many = small.withColumn(s, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return large.withColumn(s, spread).join(many, [key, s]).drop(s)
