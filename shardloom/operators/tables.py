"""Table placement: distributed (bucketed), reference and undistributed tables, shards, tenants, balance."""

from __future__ import annotations

import re
import threading
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.sources.intermediate import shared_folder

_lock = threading.Lock()
#: The table property that tells a reference table from a plain one.
KIND = "shardloom.kind"
#: The bucket in the name of a bucketed table's file.
_BUCKET = re.compile(r"_([0-9]{5})\.c[0-9]+")


def save_table(df: DataFrame, name: str, key: str | None = None, buckets: int = 0, codec: str = "zstd") -> None:
    """Store df as a table, in buckets of key if one is given.

    The files lie in a new folder of the shared place, so a table of that name from an earlier session
    is no obstacle, and results that still read the replaced table stay valid.
    """
    spark = df.sparkSession
    writer = df.write.option("compression", codec).option("path", shared_folder(spark, name.replace(".", "-")))
    if key is not None:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    new = f"{name}_{uuid.uuid4().hex}"
    writer.saveAsTable(new)  # the old table is there until the new one is whole
    with _lock:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"ALTER TABLE {new} RENAME TO {name}")


def distribute(df: DataFrame, name: str, key: str, buckets: int, colocate_with: str | None = None, codec: str = "zstd") -> None:
    """Store df as a table in buckets of hash(key), sorted by key. Rows with a null key are rejected.

    colocate_with takes the number of buckets from another table, so that joins on both keys need no
    exchange. The table is replaced if it is there.
    """
    spark = df.sparkSession
    if colocate_with is not None:
        buckets = bucket_spec(spark, colocate_with)[1]
    checked = df.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"the distribution column {key} is null")).cast(df.schema[key].dataType)).otherwise(F.col(key)))
    save_table(checked.repartition(buckets, F.col(key)), name, key, buckets, codec)


def create_reference_table(df: DataFrame, name: str) -> None:
    """Store df as a reference table: plain files, marked as such in the catalog; joins send it to all executors if it is small enough."""
    save_table(df, name)
    df.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{KIND}' = 'reference')")


def distributed(spark: SparkSession, name: str) -> DataFrame:
    """A distributed table, by name."""
    return spark.table(name)


def undistribute(spark: SparkSession, name: str, to: str) -> None:
    """Store a distributed table's rows as a plain table."""
    save_table(spark.table(name), to)


def redistribute(spark: SparkSession, name: str, to: str, key: str, buckets: int) -> None:
    """A distributed table's rows under another key or number of buckets; a table isn't overwritten while it is read."""
    if name == to:
        raise ValueError("choose another name; rename the table afterwards")
    distribute(spark.table(name), to, key, buckets)


def bucket_spec(spark: SparkSession, name: str) -> tuple[str, int]:
    """Key and number of buckets of a distributed table."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    if told.get("Num Buckets") in (None, "-1", "0"):
        raise ValueError(f"{name} isn't distributed")
    return told["Bucket Columns"].strip("[]`"), int(told["Num Buckets"])


def colocated(spark: SparkSession, a: str, b: str) -> bool:
    """True if two tables have the same number of buckets and keys of one type."""
    (ka, na), (kb, nb) = bucket_spec(spark, a), bucket_spec(spark, b)
    return na == nb and spark.table(a).schema[ka].dataType == spark.table(b).schema[kb].dataType


def shard_of(key: Column, shards: int) -> Column:
    """The bucket that Spark puts a key in."""
    return F.pmod(F.hash(key), F.lit(shards))


def bucket_of_file(path: Column) -> Column:
    """The bucket that a file of a distributed table holds, from its name."""
    return F.regexp_extract(path, _BUCKET.pattern, 1).cast("int")


def uniform_range_shard(token: Column, shards: int) -> Column:
    """The shard of a 32-bit token if the token space is cut into equal ranges; what is over belongs to the last."""
    width = (1 << 32) // shards
    return F.least(F.floor((token.cast("long") + (1 << 31)) / width), F.lit(shards - 1)).cast("int")


def token_ranges(spark: SparkSession, shards: int) -> DataFrame:
    """shard, min_token, max_token of equal ranges over the 32-bit tokens."""
    width = (1 << 32) // shards
    i = F.col("id")
    return spark.range(shards).select(i.cast("int").alias("shard"), (i * width - (1 << 31)).alias("min_token"), F.when(i == shards - 1, F.lit((1 << 31) - 1)).otherwise((i + 1) * width - (1 << 31) - 1).alias("max_token"))


def split_points(df: DataFrame, column: str, shards: int, accuracy: int = 10000) -> list:
    """Bounds that cut df into parts of about equal rows: shards - 1 values, from a sketch."""
    if shards < 2:
        return []
    return list(df.select(F.percentile_approx(column, [i / shards for i in range(1, shards)], accuracy)).first()[0])


def split_by_points(df: DataFrame, column: str, points: list) -> DataFrame:
    """df with a column shard: how many of the points (sorted) lie below the value; a point is its part's largest value. Null goes to the first."""
    return df.withColumn("shard", sum(((F.coalesce(F.col(column) > p, F.lit(False))).cast("int") for p in sorted(points)), F.lit(0)))


def isolate(df: DataFrame, column: str, tenant, shards: int) -> DataFrame:
    """df with a column shard in which one tenant has a shard of its own, the last."""
    return df.withColumn("shard", F.when(F.col(column) == F.lit(tenant), F.lit(shards)).otherwise(shard_of(F.col(column), shards)).cast("int"))


def shard_sizes(df: DataFrame, column: str, shards: int) -> DataFrame:
    """shard, n: rows by bucket of a column."""
    return df.groupBy(shard_of(F.col(column), shards).alias("shard")).agg(F.count("*").alias("n"))


def tenant_scores(events: DataFrame, tenant: str, at: str, half_life_s: float, top: int) -> DataFrame:
    """tenant, score, n: the top tenants by a count that halves every half_life_s seconds before the last event."""
    last = events.agg(F.max(at).alias("_last"))
    age = F.col("_last").cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")
    score = F.round(F.sum(F.pow(F.lit(0.5), age / half_life_s)), 6)
    return events.crossJoin(F.broadcast(last)).groupBy(tenant).agg(score.alias("score"), F.count("*").alias("n")).orderBy(F.desc("score"), tenant).limit(top)


def rebalance_plan(sizes: list[tuple[str, str, float]], nodes: list[str], threshold: float = 0.1) -> list[tuple[str, str, str]]:
    """Moves (shard, from, to) that bring all nodes within a threshold of the mean; sizes: (shard, node, size).

    The largest shard that still helps goes from the fullest to the emptiest node, until none helps.
    """
    held: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for shard, node, size in sizes:
        held.setdefault(node, {})[shard] = size
    load = lambda n: sum(held[n].values())
    mean = sum(map(load, held)) / max(1, len(nodes))
    moves: list[tuple[str, str, str]] = []
    for _ in range(len(sizes)):
        gone = [n for n in held if n not in nodes and held[n]]
        source = gone[0] if gone else max(nodes, key=load)
        target = min(nodes, key=load)
        gap = load(source) - load(target)
        if not gone and (load(source) <= mean * (1 + threshold) and load(target) >= mean * (1 - threshold)):
            break
        fit = [s for s in held[source] if gone or held[source][s] < gap]
        if not fit:
            break
        shard = max(fit, key=lambda s: (held[source][s], s))
        held[target][shard] = held[source].pop(shard)
        moves.append((shard, source, target))
    return moves


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't null and isn't in parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")


def catalog_tables(spark: SparkSession, prefix: str = "") -> DataFrame:
    """table_name, kind, distribution_column, shard_count of the stored tables: distributed ones have buckets, others are plain."""
    rows = []
    for t in spark.catalog.listTables():
        if not t.isTemporary and t.name.startswith(prefix):
            try:
                key, n = bucket_spec(spark, t.name)
                rows.append((t.name, "distributed", key, n))
            except ValueError:
                told = spark.sql(f"SHOW TBLPROPERTIES {t.name}").where(F.col("key") == KIND).collect()
                rows.append((t.name, told[0].value if told else "plain", None, None))
    return spark.createDataFrame(rows, "table_name string, kind string, distribution_column string, shard_count int")


def catalog_shards(spark: SparkSession, name: str) -> DataFrame:
    """shard, n, bytes of a distributed table's files by bucket."""
    key, n = bucket_spec(spark, name)
    rows = spark.table(name).groupBy(shard_of(F.col(key), n).alias("shard")).agg(F.count("*").alias("n"))
    every = spark.range(n).select(F.col("id").cast("int").alias("shard"))
    return every.join(rows, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def run_command_on_shards(spark: SparkSession, name: str, command: str) -> DataFrame:
    """shard and the columns of a query, in which %s stands for the shard, over each shard of a distributed table.

    A shard is the files of its bucket, so a table is read once. Shards become temporary views named table_shard, which
    catalog_tables doesn't list.
    """
    _, n = bucket_spec(spark, name)
    files: dict[int, list[str]] = {i: [] for i in range(n)}
    for f in spark.table(name).inputFiles():
        files[int(_BUCKET.search(f).group(1))].append(f)
    answers = []
    for shard, paths in files.items():
        rows = spark.read.schema(spark.table(name).schema).parquet(*paths) if paths else spark.table(name).limit(0)
        rows.createOrReplaceTempView(f"{name}_{shard}")
        answers.append(spark.sql(command.replace("%s", f"{name}_{shard}")).select(F.lit(shard).alias("shard"), "*"))
    return reduce(DataFrame.unionAll, answers)


def apply_moves(placement: DataFrame, moves: list[tuple[str, str, str]]) -> DataFrame:
    """placement (shard, node, …) after the moves of rebalance_plan; a shard that isn't where a move takes it from raises."""
    to = placement.sparkSession.createDataFrame(moves, "shard string, _from string, _to string")
    there = F.when(F.col("_from") != F.col("node"), F.raise_error(F.lit("a move starts where the shard isn't"))).otherwise(F.coalesce("_to", "node"))
    return placement.join(F.broadcast(to), "shard", "left").withColumn("node", there.cast("string")).drop("_from", "_to")


def running_jobs(spark: SparkSession) -> list[int]:
    """Ids of the jobs that run now; cancel one group with spark.interruptTag or sparkContext.cancelJobGroup."""
    return list(spark.sparkContext.statusTracker().getActiveJobsIds())
