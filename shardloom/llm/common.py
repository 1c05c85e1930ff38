"""What the operators share: names, the shared folder, Arrow batches, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import ship

#: A word is a maximal run without ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def need(df: DataFrame, *names: str) -> None:
    """Say which column is missing, before a plan is made."""
    if gone := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {gone}; there are {df.columns}")


def n_words(text: Column) -> Column:
    """The number of words of a text, as a long; null and blank texts have none."""
    kept = F.trim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))
    return F.when(kept == "", F.lit(0)).otherwise(F.size(F.split(kept, SPACE, -1))).cast("long")


def bind(value: Column, use) -> Column:
    """use(value) with value computed once: an expression that a lambda names is computed anew wherever it is named, a variable isn't."""
    return F.transform(F.array(value), use)[0]


#: Elements of a block of sweep and cut.
BLOCK = 256


def _blocks(items: Column) -> Column:
    last = F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def sweep(items: Column, step, kind: str) -> Column:
    """struct<at:int, out:array<kind>>: step(at, item) gives the next at, an element of out, and whether that is kept; at begins with 0.

    Appending to a list copies it, so elements are gathered by blocks: n items cost n * BLOCK + (n / BLOCK)^2 copied
    references, not n^2. items should be a column or a bound variable.
    """
    begin = lambda at, depth: F.struct(at.alias("at"), F.array().cast(depth.format(kind)).alias("out"))

    def inner(acc: Column, x: Column) -> Column:
        at, element, kept = step(acc["at"], x)
        return F.struct(at.cast("int").alias("at"), F.when(kept, F.concat(acc["out"], F.array(element.cast(kind)))).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, begin(acc["at"], "array<{}>"), inner)
        return bind(done, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    return F.aggregate(_blocks(items), begin(F.lit(0), "array<array<{}>>"), outer, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


def cut(text: Column, spans: Column) -> Column:
    """array<string>: text at spans (struct<start, end>, in order, apart), code points.

    A substring is searched from the text's start, so a block's stretch is taken first, and its spans from that.
    """

    def pieces(block: Column) -> Column:
        first = block[0]["start"]
        stretch = F.substring(text, first + 1, F.element_at(block, -1)["end"] - first)
        return bind(stretch, lambda x: F.transform(block, lambda s: F.substring(x, s["start"] - first + 1, s["end"] - s["start"])))

    return F.when(F.size(spans) == 0, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(_blocks(spans), pieces)))


_slot: dict = {}


def give_back() -> None:
    """Return free memory to the system; the allocators of C and Arrow would keep it for this process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def only(key, make):
    """What make() gives, kept in a Python worker until another key is asked for: reused workers go from operator to operator."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
        give_back()
    return _slot[key]


def arrow_limits(spark: SparkSession, rows: int = 1000, mb: int = 4) -> None:
    """Bound the Arrow batches that Python workers get, so that long texts don't add up; and give them this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def plain_reads(spark: SparkSession) -> None:
    """Read Parquet in steps: a vectored read of a long text column leaves direct buffers of its size with the threads that made it."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="shardloom-")
        if not held.isDefined():
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_written: dict[str, SparkSession] = {}


def _drop_all() -> None:
    for path in [*_written]:
        _delete(path)


def _delete(path: str) -> None:
    """Delete a table of shared_table; on a session that has ended, nothing is left to ask."""
    spark = _written.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of shared_table that nothing will read again, and let Spark remove shuffle files of jobs that have ended."""
    for df in tables:
        _delete(df._shared_path)
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


atexit.register(_drop_all)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)  # zstd keeps native memory for each open column
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), the smallest id of each component.

    Alternating large-star and small-star steps, each a grouped minimum and a join, so that no task
    holds a component. Every step is written to the shared folder. Rows with equal or null ends are
    left out. An empty frame gives an empty frame.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = shared_table(now, "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    last = None
    for _ in range(rounds):
        # large star: every larger neighbour of u is hung on the least of u and its neighbours
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u, are hung on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = shared_table(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        _delete(now._shared_path)
        now = new
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    root = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(root)
