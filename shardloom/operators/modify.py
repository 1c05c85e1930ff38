"""Data modification as functions from tables to tables.

Parquet files aren't changed in place: each function returns the table's new state (and, where asked,
the rows that changed). store() writes a state to a new folder and moves the table's name to it in one
step, so readers see the old state or the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cast_like(df: DataFrame, changes: Mapping[str, Column]) -> dict[str, Column]:
    if odd := [c for c in changes if c not in df.columns]:
        raise ValueError(f"no columns {odd}")
    return {c: v.cast(df.schema[c].dataType) for c, v in changes.items()}


def update(df: DataFrame, where: Column, changes: Mapping[str, Column]) -> DataFrame:
    """UPDATE df SET … WHERE …; all new values are computed from the old row."""
    hit = F.coalesce(where, F.lit(False))
    new = _cast_like(df, changes)
    return df.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def updated_rows(df: DataFrame, where: Column, changes: Mapping[str, Column]) -> DataFrame:
    """What UPDATE … RETURNING * returns."""
    new = _cast_like(df, changes)
    return df.where(where).select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def deleted_rows(df: DataFrame, where: Column) -> DataFrame:
    """What DELETE … RETURNING * returns."""
    return df.where(where)


def inserted_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """What INSERT … RETURNING * returns: the new rows as they are stored, in the types and columns of df."""
    return df.limit(0).unionByName(rows.select(*[F.col(c).cast(df.schema[c].dataType) for c in rows.columns]), allowMissingColumns=True)


def merge_returning(df: DataFrame, source: DataFrame, key: str, source_key: str, clauses: list[When]) -> DataFrame:
    """What MERGE … RETURNING merge_action(), * returns: the rows that were inserted, updated (as they are then) or deleted (as they were), with _action."""
    return merge(df, source, key, source_key, clauses, delta=True).where(F.col("_action").isin("insert", "update", "delete"))


def delete(df: DataFrame, where: Column) -> DataFrame:
    """DELETE FROM df WHERE …; rows for which the condition is null stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_using(df: DataFrame, source: DataFrame, on: Column) -> DataFrame:
    """DELETE FROM df USING source WHERE on."""
    return df.join(source, on, "left_anti")


def update_from(df: DataFrame, source: DataFrame, key: str, source_key: str, changes: Mapping[str, Column]) -> DataFrame:
    """UPDATE df SET … FROM source WHERE key = source_key. A source key that occurs twice would make the result arbitrary; it raises."""
    return merge(df, source, key, source_key, [When("matched", None, "update", changes)])


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT INTO df (columns of rows) SELECT …; missing columns are null."""
    return df.unionByName(rows.select(*[F.col(c).cast(df.schema[c].dataType) for c in rows.columns]), allowMissingColumns=True)


def upsert(df: DataFrame, rows: DataFrame, key: str, changes: Mapping[str, Column] | None = None) -> DataFrame:
    """INSERT … ON CONFLICT (key) DO UPDATE SET changes, or DO NOTHING without changes. In changes, excluded.c is the new row's value.

    Rows that repeat a key raise with changes; without them the first by all columns is taken.
    """
    if changes is None:
        one = rows.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("_r")).select("_r.*")
        return insert(df, one.join(df.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti"))
    return merge(df, rows, key, key, [When("matched", None, "update", changes), When("not matched", None, "insert", {c: F.col(f"excluded.{c}") for c in rows.columns})])


@dataclass(frozen=True)
class When:
    """A clause of MERGE: for matched, not matched (by target), not matched by source; an action: update, insert, delete, nothing."""

    kind: str
    condition: Column | None
    action: str
    changes: Mapping[str, Column] | None = None


def merge(df: DataFrame, source: DataFrame, key: str, source_key: str, clauses: list[When], delta: bool = False, keyed: bool = False) -> DataFrame:
    """MERGE INTO df USING source ON key = source_key WHEN …: a full outer join on the key, and the first clause that holds.

    In conditions and changes, plain names are the target's columns and excluded.c the source's.
    A key of the target mustn't be changed. A source row that matches a target row which another source
    row has matched raises, as it must. With delta, the column _action tells what became of each row.
    keyed says that no source key is null, as in distributed tables; then co-located tables are merged without an exchange.
    """
    for c in clauses:
        if c.kind == "matched" and c.action == "update" and key in (c.changes or {}):
            raise ValueError("the key can't be updated")
        if c.kind not in ("matched", "not matched", "not matched by source"):
            raise ValueError(f"unknown clause {c.kind}")
    twice = F.when(F.count("*") > 1, F.raise_error(F.lit("a row can't be modified twice by one MERGE")).cast("boolean")).otherwise(F.lit(True))
    one = source.where(F.col(source_key).isNotNull()).groupBy(source_key).agg(F.first(F.struct(*source.columns)).alias("excluded"), twice.alias("_once"))
    unkeyed = source.where(F.col(source_key).isNull()).select(F.lit(None).cast(source.schema[source_key].dataType).alias(source_key), F.struct(*source.columns).alias("excluded"), F.lit(True).alias("_once"))
    side = (one if keyed else one.unionByName(unkeyed)).withColumnRenamed(source_key, "_source_key").withColumn("_s", F.lit(True))
    both = df.withColumn("_t", F.lit(True)).join(side, F.col(key) == F.col("_source_key"), "full_outer")
    t, s = F.col("_t").isNotNull(), F.col("_s").isNotNull()
    kinds = {"matched": t & s & F.coalesce(F.col("_once"), F.lit(True)), "not matched": ~t & s, "not matched by source": t & ~s}
    action = F.when(F.lit(False), F.lit(-1))
    for i, c in enumerate(clauses):
        holds = kinds[c.kind] if c.condition is None else kinds[c.kind] & F.coalesce(c.condition, F.lit(False))
        action = action.when(holds, F.lit(i))
    both = both.withColumn("_a", action.otherwise(F.lit(-1)))
    gone = [i for i, c in enumerate(clauses) if c.action == "delete"]
    born = [i for i, c in enumerate(clauses) if c.action == "insert"]
    kept = both.where((t & ~F.col("_a").isin(gone or [-2])) | F.col("_a").isin(born or [-2]))
    out = []
    for name in df.columns:
        value = F.col(name)
        for i, c in enumerate(clauses):
            if c.action in ("update", "insert") and name in (c.changes or {}):
                value = F.when(F.col("_a") == i, c.changes[name].cast(df.schema[name].dataType)).otherwise(value)
        out.append(value.alias(name))
    if delta:
        names = F.array(*[F.lit(c.action) for c in clauses] or [F.lit("")])
        return both.select(*out, F.when(F.col("_a") >= 0, F.get(names, F.col("_a"))).otherwise(F.lit("keep")).alias("_action"))
    return kept.select(*out)


def truncate(df: DataFrame) -> DataFrame:
    """TRUNCATE: no rows, the same columns."""
    return df.limit(0)


def store(df: DataFrame, root: str) -> str:
    """Write a state below root and point root/CURRENT at it, the last step; the new folder."""
    spark = df.sparkSession
    path = f"{root}/state-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = fs_path(f"{root}/CURRENT.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(path.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    files.rename(new, fs_path(f"{root}/CURRENT"), how)  # replaces the pointer in one step: there is always one
    return path


def current(spark, root: str) -> DataFrame:
    """The state that root/CURRENT points at."""
    return spark.read.parquet(spark.read.text(f"{root}/CURRENT").first()[0])
