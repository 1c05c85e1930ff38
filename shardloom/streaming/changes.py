"""Change streams: applying changes, deduplication, rollups, windows and a causal clock."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a change: op is insert, update or delete; seq orders changes.
OP, SEQ = "op", "seq"


def adapt(change: DataFrame, schema) -> DataFrame:
    """Changes in the columns of the table now: dropped columns are left out, added ones are null."""
    have = set(change.columns)
    return change.select(OP, SEQ, *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def latest(change: DataFrame, key: str) -> DataFrame:
    """The last change of each key by seq; grouped, so a hot key's changes are reduced where they are read."""
    rest = [c for c in change.columns if c not in (key, SEQ)]
    return change.groupBy(key).agg(F.max(SEQ).alias(SEQ), F.max_by(F.struct(*rest), SEQ).alias("_r")).select(key, SEQ, "_r.*")


def apply_changes(state: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """The table after a batch of changes."""
    last = latest(adapt(change, state.schema), key)
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(OP) != "delete").select(*state.columns))


def changes_between(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What turned a table's state old into new: op (insert, update, delete) and the row, as it is now or, deleted, as it was.

    Keys are unique and not null. Rows that stayed as they were give nothing.
    """
    before, after = (t.select(F.col(key).alias("_key"), F.struct(*new.columns).alias(n)) for t, n in ((old, "_old"), (new, "_new")))
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    moved = before.join(after, "_key", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return moved.select(op.alias("op"), F.coalesce("_new", "_old").alias("_row")).select("op", "_row.*")


def publish(change: DataFrame, shard_tables: dict[str, str]) -> DataFrame:
    """Changes of shards as changes of their tables: shard is replaced by table; changes that a shard move makes itself (moved) are left out."""
    names = F.create_map(*[F.lit(x) for pair in shard_tables.items() for x in pair])
    out = change.where(~F.coalesce(F.col("moved"), F.lit(False))) if "moved" in change.columns else change
    return out.withColumn("table", F.coalesce(names[F.col("shard")], F.col("shard"))).drop("shard", "moved")


def run_to_files(df: DataFrame, root: str, mode: str) -> DataFrame:
    """Run a stream over what is there now; its result as files below root, a folder that driver and executors share.

    append adds to one table through the file sink, which keeps a log of its files, so that a batch sent again adds
    nothing; complete writes each batch's whole result under its number, and the last one holds.
    """
    if mode == "append":
        q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out")
    last = []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number}")
        last[:] = [number]

    df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out/{last[0]}") if last else df.sparkSession.createDataFrame([], df.schema)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch of what is there now to a function; a batch that is sent again has the same number."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(stream: DataFrame, at: str, size: str, late: str, *keys: str) -> DataFrame:
    """window, keys, n, total of value by windows of a size; events later than late behind the newest are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    """The first event of each key among those that are at most late apart."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


class CausalClock:
    """A logical clock (epoch milliseconds, counter) that never goes back and follows the clocks that it hears of."""

    COUNTER_MOST = (1 << 22) - 1

    def __init__(self) -> None:
        self._now = (0, 0)
        self._lock = threading.Lock()

    def tick(self, wall_ms: int | None = None) -> tuple[int, int]:
        """The next value: the wall clock if it is ahead, else one more."""
        wall = (int(time.time() * 1000) if wall_ms is None else wall_ms, 0)
        with self._lock:
            ms, n = self._now
            self._now = wall if wall > self._now else (ms, n + 1) if n < self.COUNTER_MOST else (ms + 1, 0)
            return self._now

    def adjust(self, other: tuple[int, int]) -> tuple[int, int]:
        """Catch up with another clock."""
        with self._lock:
            self._now = max(self._now, other)
            return self._now


def clock(ms: Column, counter: Column) -> Column:
    """A clock value as a struct: Spark compares structs field by field."""
    return F.struct(ms.cast("long").alias("epoch_ms"), counter.cast("int").alias("counter"))


def in_order(change: DataFrame, key: str) -> DataFrame:
    """Changes with their place (n) in the order of each key."""
    return change.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(SEQ)))


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
