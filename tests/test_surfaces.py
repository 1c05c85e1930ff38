"""Edges of gapped frames, rows by number, captured changes, lines of a client and fingerprints."""

from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shardloom.operators import tables as P
from shardloom.operators.rewrites import aggregate_excluding
from shardloom.operators.statistics import explain, fingerprint, is_volatile
from shardloom.sources import columnar as C
from shardloom.sources.copying import copy_from_lines, copy_from_program
from shardloom.streaming.changes import changes_between


def test_gapped_frames_without_values(spark):
    """A lone row and a row whose neighbours are null: sums are null, counts 0."""
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, None), (2, 2, 7.0)], "k int, o int, v double")
    w = Window.partitionBy("k").orderBy("o")
    got = df.select("k", "o", *[aggregate_excluding(a, F.col("v"), w.rowsBetween(-1, -1), w.rowsBetween(1, 1)).alias(a) for a in ("sum", "count", "min", "avg")]).collect()
    assert sorted(map(tuple, got)) == [(1, 1, None, 0, None, None), (2, 1, 7.0, 1, 7.0, 7.0), (2, 2, None, 0, None, None)]
    with pytest.raises(ValueError):
        aggregate_excluding("mode", F.col("v"), w, w)


def test_rows_at_opens_only_files_that_hold_them(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    C.write_columnar(spark.range(1000).repartitionByRange(5, "id"), path, order_by=["id"])
    got = C.rows_at(spark, path, [0, 0, 999, 5000])
    assert sorted(map(tuple, got.select("row_number", "id").collect())) == [(0, 0), (999, 999)]
    assert len(got.inputFiles()) == 2
    none = C.rows_at(spark, path, [])
    assert none.columns == ["id", "row_number"] and none.count() == 0


def test_changes_of_nulls_and_of_nothing(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, None), (4, None)], "k int, v string")
    assert sorted(map(tuple, changes_between(old, new, "k").collect())) == [("delete", 3, "b"), ("insert", 4, None), ("update", 2, None)]
    assert changes_between(old, old, "k").count() == 0


def test_a_malformed_line_and_a_failing_program_raise(spark):
    with pytest.raises(Exception):
        copy_from_lines(spark, ["x,a"], "id int, v string").collect()
    with pytest.raises(subprocess.CalledProcessError):
        copy_from_program(spark, ["false"], "id int")
    assert copy_from_lines(spark, [], "id int").count() == 0


def test_fingerprints_and_plans(spark):
    assert fingerprint("SELECT t1.a, 'it''s'\n FROM t1 WHERE b = 2.5") == "SELECT t1.a, $1 FROM t1 WHERE b = $2"
    df = spark.range(10)
    assert is_volatile(df, "rand()") and not is_volatile(df, "id + 1")
    plan = explain(df.groupBy((F.col("id") % 3).alias("g")).count(), "analyze")
    assert "HashAggregate rows=3" in plan
    with pytest.raises(ValueError):
        explain(df, "yaml")


def test_commands_see_empty_shards_and_moves_start_where_shards_are(spark):
    P.distribute(spark.range(1).withColumnRenamed("id", "k"), "t_few", "k", 4)
    told = P.run_command_on_shards(spark, "t_few", "SELECT count(*) AS n FROM %s")
    assert sorted(r.n for r in told.collect()) == [0, 0, 0, 1]
    placed = spark.createDataFrame([("0", "a"), ("1", "b")], "shard string, node string")
    assert sorted(map(tuple, P.apply_moves(placed, [("0", "a", "b")]).select("shard", "node").collect())) == [("0", "b"), ("1", "b")]
    with pytest.raises(Exception, match="where the shard isn't"):
        P.apply_moves(placed, [("1", "a", "b")]).collect()
