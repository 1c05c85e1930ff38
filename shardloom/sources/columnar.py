"""Columnar storage: writing with options, what the files hold, skipping by statistics."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CODECS = ("none", "lz4", "zstd", "snappy", "gzip")


@dataclass(frozen=True)
class ColumnarOptions:
    """Compression, its level (1 to 19), rows of a stripe (row group) and of a chunk (page)."""

    compression: str = "zstd"
    level: int = 3
    stripe_rows: int = 150_000
    chunk_rows: int = 10_000

    def __post_init__(self) -> None:
        if self.compression not in CODECS:
            raise ValueError(f"compression is one of {CODECS}")
        if not 1 <= self.level <= 19 or not 1000 <= self.stripe_rows <= 10_000_000 or not 1000 <= self.chunk_rows <= 100_000:
            raise ValueError("an option is out of its range")


def write_columnar(df: DataFrame, path: str, options: ColumnarOptions = ColumnarOptions(), order_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Append-only columnar files; sorted by columns within each file, so that their chunks' ranges are narrow."""
    if order_by:
        df = df.sortWithinPartitions(*order_by)
    w = df.write.mode(mode).option("compression", options.compression)
    w = w.option("parquet.compression.codec.zstd.level", options.level).option("parquet.page.row.count.limit", options.chunk_rows).option("parquet.block.row.count.limit", options.stripe_rows)
    w.parquet(path)


def read_columnar(spark: SparkSession, path: str, defaults: dict | None = None, schema=None) -> DataFrame:
    """Read columnar files; columns that older files lack take a default."""
    df = (spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")).parquet(path)
    for c, value in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in df.columns else F.lit(value))
    return df


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """n: the rows of columnar files, from their footers alone: the count is pushed into the scan, which opens no column."""
    v1 = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(v1)
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set(v1, ",".join(x for x in before.split(",") if x != "parquet"))
    try:
        return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
    finally:
        spark.conf.set(v1, before)


def rows_read(df: DataFrame) -> tuple[int, int]:
    """How many rows the scan of df hands on after it skipped chunks by their statistics, and how many rows df has. Runs df."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = df._jdf.queryExecution()
        n = execution.toRdd().count()
        leaves = execution.executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())), n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def rows_at(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The rows of these numbers, with row_number; rows are numbered from 0 by file name and place in the file.

    One row for each file tells where its numbers begin; only files that hold a number asked for are opened.
    A number beyond the last row gives no row.
    """
    place = F.col("_metadata.file_path").alias("_file")
    files = spark.read.parquet(path).select(place).groupBy("_file").agg(F.count("*").alias("_rows"))
    first = F.coalesce(F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.withColumn("_first", first)
    asked = spark.createDataFrame([(int(n),) for n in sorted(set(numbers))], "row_number long")
    hits = [tuple(h) for h in asked.join(starts, (F.col("row_number") >= F.col("_first")) & (F.col("row_number") < F.col("_first") + F.col("_rows"))).select("row_number", "_file", F.col("row_number") - F.col("_first")).collect()]
    if not hits:
        return spark.read.parquet(path).limit(0).withColumn("row_number", F.lit(None).cast("long"))
    rows = spark.read.parquet(*sorted({h[1] for h in hits})).select("*", place, F.col("_metadata.row_index").alias("_index"))
    wanted = spark.createDataFrame(hits, "row_number long, _file string, _index long")
    return rows.join(F.broadcast(wanted), ["_file", "_index"]).drop("_file", "_index")


_SCHEMA = "path string, stripe int, column string, rows long, bytes long, raw_bytes long, compression string, min string, max string, nulls long"


def chunk_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, stripe and column: rows, sizes, codec, smallest and largest value.

    The reader hands each file on as a whole (up to 2 GB), of which only the footer is parsed; row_count opens footers alone.
    """

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"]):
                meta = pq.read_metadata(io.BytesIO(content))
                rows = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        col = group.column(c)
                        s = col.statistics
                        has = s is not None and s.has_min_max
                        rows.append((where, g, col.path_in_schema, group.num_rows, col.total_compressed_size, col.total_uncompressed_size, col.compression, str(s.min) if has else None, str(s.max) if has else None, s.null_count if s is not None and s.has_null_count else None))
                yield pd.DataFrame(rows, columns=["path", "stripe", "column", "rows", "bytes", "raw_bytes", "compression", "min", "max", "nulls"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(footers, _SCHEMA)


def table_size(spark: SparkSession, path: str) -> DataFrame:
    """rows, bytes, raw_bytes, compression_rate of columnar files."""
    s = chunk_statistics(spark, path)
    rows = s.select("path", "stripe", "rows").distinct().agg(F.sum("rows").alias("rows"))
    sizes = s.agg(F.sum("bytes").alias("bytes"), F.sum("raw_bytes").alias("raw_bytes"))
    return rows.crossJoin(sizes).withColumn("compression_rate", F.round(F.col("raw_bytes") / F.col("bytes"), 4))


def compact(spark: SparkSession, path: str, to: str, file_bytes: int = 512 << 20) -> int:
    """Rewrite many small files as files of about file_bytes (what VACUUM does for a columnar table); the number of files now."""
    total = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0] or 0
    spark.read.parquet(path).repartition(max(1, -(-total // file_bytes))).write.option("compression", "zstd").parquet(to)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(to).count()


def set_access_method(spark: SparkSession, path: str, to: str, method: str, options: ColumnarOptions = ColumnarOptions()) -> None:
    """Rewrite files in another format: columnar (Parquet), orc, or row (Avro-like text rows: JSON lines)."""
    df = spark.read.parquet(path) if method != "columnar" else _read_any(spark, path)
    if method == "columnar":
        write_columnar(df, to, options)
    elif method == "orc":
        df.write.orc(to)
    elif method == "row":
        df.write.json(to)
    else:
        raise ValueError("method is columnar, orc or row")


def _read_any(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    name = files[0].path if files else ".parquet"
    return spark.read.orc(path) if name.endswith(".orc") else spark.read.json(path) if name.endswith(".json") else spark.read.parquet(path)
