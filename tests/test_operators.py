"""Operators on small tables: nulls, ties, empty tables, errors, plans."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shardloom.operators import modify as M
from shardloom.operators import tables as P
from shardloom.operators.aggregates import array_agg, json_object_agg
from shardloom.operators.joins import overlap_join, range_join, reference_join, salted_join
from shardloom.operators.numbering import number_rows
from shardloom.operators.rewrites import distinct_on, greater_than_all, recursive_union, with_ties
from shardloom.sources.columnar import ColumnarOptions, chunk_statistics, table_size, write_columnar
from shardloom.sources.timeparts import partition_ranges
from shardloom.streaming.changes import CausalClock, apply_changes


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_with_ties_keeps_equals_and_offset(spark):
    t = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, 7), (5, 9), (6, None)], "id int, v int")
    assert values(with_ties(t, "v", 3).select("id")) == [(1,), (2,), (3,), (4,)]
    assert sorted(with_ties(t, "v", 1, offset=2).select("id").collect())[0].id in (3, 4)
    assert with_ties(t, "v", 100).count() == 6
    assert with_ties(t, "v", 0).count() == 0


def test_distinct_on(spark):
    t = spark.createDataFrame([(1, 3), (1, 2), (None, 1)], "k int, v int")
    assert values(distinct_on(t, ["k"], [F.asc("v")])) == [(1, 2), (None, 1)]


def test_all_with_nulls_and_empty_set(spark):
    a = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    some = spark.createDataFrame([(2,), (3,)], "x int")
    assert values(greater_than_all(a, "v", some, "x")) == [(5,)]
    assert greater_than_all(a, "v", some.where("false"), "x").count() == 3
    assert greater_than_all(a, "v", some.union(spark.createDataFrame([(None,)], "x int")), "x").count() == 0


def test_recursion_ends_in_cycles(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 9)], "a int, b int")
    step = lambda new: new.join(edges, F.col("k") == F.col("a")).select(F.col("b").alias("k"))
    assert values(recursive_union(spark.createDataFrame([(1,)], "k int"), step, f"file://{tmp_path}/r")) == [(1,), (2,), (3,)]


def test_array_agg_keeps_nulls_and_object_takes_last(spark):
    t = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "o int, v string")
    assert t.agg(array_agg(F.col("v"), F.col("o")).alias("a")).first().a == [None, "b", "a"]
    u = spark.createDataFrame([("k", 1), ("k", 2), ("j", None)], "k string, v int")
    assert u.agg(json_object_agg(F.col("k"), F.col("v")).alias("o")).first().o == '{"j":null,"k":2}'


def test_reference_join_broadcasts_only_small_tables(spark):
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    with_hint = reference_join(a, b, "k")._jdf.queryExecution().optimizedPlan().toString()
    without = reference_join(a, b, "k", most_bytes=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in with_hint and "strategy=broadcast" not in without


def test_range_and_salted_join_match_plain_ones(spark):
    r = random.Random(3)
    points = spark.createDataFrame([(i, r.uniform(0, 50)) for i in range(200)], "id int, at double")
    bands = spark.createDataFrame([(i, i * 2.0, i * 2.0 + r.uniform(0, 6)) for i in range(20)], "b int, lo double, hi double")
    want = points.join(bands, (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("id", "b")
    assert values(range_join(points, bands, "at", "lo", "hi", 3.0).select("id", "b")) == values(want)
    hot = spark.createDataFrame([(7, i) for i in range(50)] + [(1, 0)], "k int, x int")
    small = spark.createDataFrame([(7, "a"), (7, "b"), (2, "c")], "k int, y string")
    assert values(salted_join(hot, small, "k").select("k", "x", "y")) == values(hot.join(small, "k").select("k", "x", "y"))


def test_colocated_join_has_no_exchange(spark):
    P.distribute(spark.range(50).withColumnRenamed("id", "k"), "tc_a", "k", 4)
    P.distribute(spark.range(50).withColumnRenamed("id", "k"), "tc_b", "k", 0, colocate_with="tc_a")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table("tc_a").join(spark.table("tc_b"), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    assert P.colocated(spark, "tc_a", "tc_b")


def test_null_distribution_key_is_rejected(spark):
    with pytest.raises(Exception, match="distribution column"):
        P.distribute(spark.createDataFrame([(None,)], "k int"), "tc_null", "k", 2)


def test_merge_rules(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    x = lambda c: F.col(f"excluded.{c}")
    both = [M.When("matched", None, "update", {"v": x("v")}), M.When("not matched", None, "insert", {"k": x("k"), "v": x("v")})]
    assert values(M.merge(t, s, "k", "k", both)) == values(spark.createDataFrame([(1, "a"), (2, "B"), (3, "C"), (None, "n"), (None, "N")], "k int, v string"))
    twice = s.union(spark.createDataFrame([(2, "BB")], "k int, v string"))
    with pytest.raises(Exception, match="modified twice"):
        M.merge(t, twice, "k", "k", both).collect()
    with pytest.raises(ValueError, match="key"):
        M.merge(t, s, "k", "k", [M.When("matched", None, "update", {"k": F.lit(1)})])
    assert M.merge(t.limit(0), s.limit(0), "k", "k", both).count() == 0


def test_update_and_delete_with_null_conditions(spark):
    t = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    assert values(M.delete(t, F.col("v") > 1)) == [(1, None)]
    assert values(M.update(t, F.col("v") > 1, {"v": F.col("v") + 1})) == [(1, None), (2, 6)]
    with pytest.raises(ValueError, match="no columns"):
        M.update(t, F.lit(True), {"zzz": F.lit(1)})


def test_insert_casts_and_fills(spark):
    t = spark.createDataFrame([(1, "a")], "k long, v string")
    assert values(M.insert(t, spark.createDataFrame([(2,)], "k int"))) == [(1, "a"), (2, None)]


def test_columnar_options_and_statistics(spark, tmp_path):
    with pytest.raises(ValueError):
        ColumnarOptions(compression="pglz")
    with pytest.raises(ValueError):
        ColumnarOptions(stripe_rows=10)
    path = f"file://{tmp_path}/c"
    write_columnar(spark.range(5000).withColumn("n", F.lit(None).cast("string")), path, order_by=["id"])
    s = {(r.column): r for r in chunk_statistics(spark, path).where("stripe = 0").collect()}
    assert s["n"].min is None and s["id"].min is not None
    assert table_size(spark, path).first().rows == 5000


def test_partition_ranges():
    day = timedelta(days=1)
    got = partition_ranges(datetime(2024, 1, 1, 5), datetime(2024, 1, 3), day)
    assert got == [(datetime(2024, 1, 1), datetime(2024, 1, 2)), (datetime(2024, 1, 2), datetime(2024, 1, 3))]
    with pytest.raises(ValueError):
        partition_ranges(datetime(2024, 1, 1), datetime(2024, 1, 3), timedelta(0))


def test_clock_never_goes_back():
    c = CausalClock()
    a = c.tick(1000)
    assert c.tick(900) == (1000, 1) > a
    c.adjust((5000, 7))
    assert c.tick(2000) == (5000, 8)
    c.adjust((5000, CausalClock.COUNTER_MOST))
    assert c.tick(1) == (5001, 0)


def test_apply_changes_in_any_order(spark):
    state = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    log = spark.createDataFrame([("delete", 3, 1, None), ("update", 1, 1, 11), ("insert", 2, 5, 50), ("update", 4, 5, 51)], "op string, seq int, k int, v int")
    assert values(apply_changes(state, log, "k")) == [(2, 20), (5, 51)]
    assert values(apply_changes(state, log.limit(0), "k")) == [(1, 10), (2, 20)]


def test_rebalance_drains_gone_nodes():
    moves = P.rebalance_plan([("s1", "x", 2.0), ("s2", "a", 2.0)], ["a", "b"])
    assert ("s1", "x", "b") in moves
    assert P.rebalance_plan([], ["a"]) == []


@pytest.mark.parametrize("seed", range(6))
def test_random_join_trees_agree(spark, seed):
    """Random joins over tables with nulls and repeats: shuffled, salted by buckets, and broadcast plans give one result."""
    r = random.Random(seed)
    rows = lambda: [(None if r.random() < 0.1 else r.randrange(6),) for _ in range(12)]
    tables = [spark.createDataFrame(rows(), f"k{i} int") for i in range(3)]
    hows = [r.choice(["inner", "left", "right", "full", "left_semi", "left_anti"]) for _ in range(2)]

    def tree(hint):
        df = tables[0]
        for i, how in enumerate(hows, 1):
            df = df.join(tables[i].hint(hint), F.col("k0") == F.col(f"k{i}"), how)
        return values(df)

    assert tree("merge") == tree("broadcast") == tree("shuffle_hash")


def test_ranges_enums_and_domains(spark):
    from shardloom.functions import ranges as R

    t = spark.createDataFrame([(1, 3, 3, 5), (1, 3, 4, 5), (None, 2, 1, 9), (5, 5, 4, 6)], "a int, b int, c int, d int")
    half, closed = lambda x, y: R.make_range(F.col(x), F.col(y)), lambda x, y: R.make_range(F.col(x), F.col(y), "[]")
    got = t.select(R.overlaps(half("a", "b"), half("c", "d")), R.overlaps(closed("a", "b"), closed("c", "d")), R.contains(half("a", "b"), F.lit(2)), R.is_empty(half("a", "b"))).collect()
    assert [tuple(x) for x in got] == [(False, True, True, False), (False, False, True, False), (True, True, False, False), (False, True, False, True)]
    with pytest.raises(ValueError):
        R.make_range(F.lit(1), F.lit(2), "<>")
    with pytest.raises(Exception, match="not a label"):
        spark.createDataFrame([("x",)], "v string").select(R.enum_rank(F.col("v"), ["a"])).collect()
    with pytest.raises(Exception, match="violates domain"):
        t.select(R.domain(F.col("b"), F.col("b") < 5, "small")).collect()
    assert spark.createDataFrame([(None,)], "v int").select(R.domain(F.col("v"), F.col("v") > 0, "p").alias("v")).first().v is None


def test_similar_to(spark):
    from shardloom.functions.text import similar_to

    t = spark.createDataFrame([("abc",), ("a.c",), ("xabc",), ("a%c",), ("",), (None,)], "s string")
    hit = lambda p: [x.s for x in t.where(similar_to(F.col("s"), p)).collect()]
    assert hit("a_c") == ["abc", "a.c", "a%c"] and hit("a.c") == ["a.c"] and hit("%(b|%)c") == ["abc", "a.c", "xabc", "a%c"]
    assert hit("a\\%c") == ["a%c"] and hit("%") == ["abc", "a.c", "xabc", "a%c", ""]


def test_numbers_are_consecutive_over_partitions(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)] + [(5, 5000)] * 700 + [(None, 1)]
    t = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = number_rows(t, ["k", "v"], start=0).collect()
    assert sorted(r.id for r in got) == list(range(len(rows)))
    ranked = [(r.k, r.v) for r in sorted(got, key=lambda r: r.id)]
    assert ranked == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert number_rows(t.limit(0), ["k"]).count() == 0


def test_overlap_join_gives_each_pair_once(spark):
    rng = random.Random(4)
    a, b = ([(i, x := rng.uniform(-50, 50), x + rng.uniform(-1, 30)) for i in range(60)] for _ in range(2))
    none = (99, None, 3.0)
    left = spark.createDataFrame([*a, none], "i int, p double, q double")
    right = spark.createDataFrame([*b, none], "j int, r double, s double")
    want = sorted((i, j) for i, p, q in a for j, r, s in b if p < q and r < s and p < s and r < q)
    found = overlap_join(left, right, ("p", "q"), ("r", "s"), 4.0).select("i", "j")
    assert values(found) == sorted(want, key=repr)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan
