"""Forms that Spark's SQL lacks, written with those that it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """SELECT DISTINCT ON (keys): the first row of each key by an order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_ties(df: DataFrame, column: str, n: int, offset: int = 0, descending: bool = False) -> DataFrame:
    """ORDER BY column OFFSET offset FETCH FIRST n ROWS WITH TIES, nulls last.

    A top-k (no full sort) finds the value of row offset + n; only rows up to that value are ranked.
    The rows before the offset are cut off in that order, with ties in any order, as a database does.
    """
    if n <= 0:
        return df.limit(0)
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    edge = df.select(column).orderBy(order).limit(offset + n).select(F.struct(F.col(column).isNull().alias("null"), F.col(column).alias("v")).alias("e"))
    last = edge.agg(F.max(F.col("e.null")).alias("_null"), (F.min if descending else F.max)("e.v").alias("_edge"))
    inside = F.col("_null") | (F.col(column) >= F.col("_edge") if descending else F.col(column) <= F.col("_edge"))
    near = df.crossJoin(F.broadcast(last)).where(inside).drop("_null", "_edge")
    return near.orderBy(order).offset(offset) if offset else near


def groups_frame(w: WindowSpec, order: list[Column], df: DataFrame, preceding: int, following: int, partition: list[str]) -> tuple[DataFrame, WindowSpec]:
    """GROUPS BETWEEN preceding PRECEDING AND following FOLLOWING: df with a column _group, and the window over it."""
    numbered = df.withColumn("_group", F.dense_rank().over(w.orderBy(*order)))
    return numbered, Window.partitionBy(*partition).orderBy("_group").rangeBetween(-preceding, following)


def sum_excluding_current(value: Column, w: WindowSpec, preceding: int, following: int) -> Column:
    """sum(value) over ROWS BETWEEN preceding PRECEDING AND following FOLLOWING EXCLUDE CURRENT ROW; null if no other value is there."""
    before, after = F.sum(value).over(w.rowsBetween(-preceding, -1)), F.sum(value).over(w.rowsBetween(1, following))
    return F.when(before.isNull(), after).when(after.isNull(), before).otherwise(before + after)


def aggregate_excluding(name: str, value: Column, before: WindowSpec, after: WindowSpec, own: bool = False) -> Column:
    """sum, count, min, max or avg of value over a frame with a gap: the frames before and after it, joined.

    EXCLUDE CURRENT ROW takes frames of rows that leave the row out; EXCLUDE GROUP frames over group numbers
    (groups_frame) that leave its group out; EXCLUDE TIES the same with own, by which the row itself counts again.
    """
    if name in ("min", "max"):
        one, both = (F.min, F.least) if name == "min" else (F.max, F.greatest)
        return both(one(value).over(before), one(value).over(after), *([value] if own else []))
    n = F.count(value).over(before) + F.count(value).over(after) + (value.isNotNull().cast("long") if own else F.lit(0))
    if name == "count":
        return n
    if name not in ("sum", "avg"):
        raise ValueError("the aggregate is sum, count, min, max or avg")
    zero = F.lit(0)
    total = F.coalesce(F.sum(value).over(before), zero) + F.coalesce(F.sum(value).over(after), zero) + (F.coalesce(value, zero) if own else zero)
    return F.when(n > 0, total if name == "sum" else total / n)


def greater_than_all(df: DataFrame, value: str, others: DataFrame, other: str, on: Column | None = None) -> DataFrame:
    """Rows of df for which value > ALL (SELECT other FROM others [WHERE on]): a comparison that is null fails, an empty set passes.

    Without on, the set is summed up first: one row with its largest value, its size, and how many nulls it holds.
    """
    if on is not None:
        return df.join(others, on & ~F.coalesce(F.col(value) > F.col(other), F.lit(False)), "left_anti")
    told = others.agg(F.max(other).alias("_most"), F.count("*").alias("_n"), F.count(other).alias("_known"))
    fine = (F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & (F.col(value) > F.col("_most")))
    return df.crossJoin(F.broadcast(told)).where(fine).drop("_most", "_n", "_known")


def greater_than_any(df: DataFrame, value: str, others: DataFrame, other: str) -> DataFrame:
    """Rows of df for which value > ANY (SELECT other FROM others): larger than the smallest value."""
    told = others.agg(F.min(other).alias("_least"))
    return df.crossJoin(F.broadcast(told)).where(F.col(value) > F.col("_least")).drop("_least")


def recursive_union(seed: DataFrame, step, shared: str, rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE … UNION (distinct): rows that seed and repeated steps reach.

    step(new) gives what follows from the rows that were new in the last round. Each round is written
    below the folder shared and read again, so plans stay short and lost executors cost one round.
    """
    spark = seed.sparkSession
    seed.distinct().write.mode("overwrite").parquet(f"{shared}/0")
    seen = new = spark.read.parquet(f"{shared}/0")
    for k in range(1, rounds):
        more = step(new).distinct().join(seen.select(*[F.col(c).alias(f"_{c}") for c in seen.columns]), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in seen.columns], "left_anti")
        more.write.mode("overwrite").parquet(f"{shared}/{k}")
        new = spark.read.schema(seed.schema).parquet(f"{shared}/{k}")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise RuntimeError(f"the recursion didn't end in {rounds} rounds")


def approximate_top(df: DataFrame, order: list[Column], n: int, per_task: int) -> DataFrame:
    """ORDER BY … LIMIT n from at most per_task rows of each partition; per_task = -1 takes all (exact)."""
    if per_task < 0:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy("_task").orderBy(*order)
    some = df.withColumn("_task", F.spark_partition_id()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_task)
    return some.drop("_task", "_n").orderBy(*order).limit(n)
