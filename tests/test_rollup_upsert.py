"""The incremental rollup goes through an upsert, with groups that both batches hold."""

from __future__ import annotations

from shardloom.operators import modify as M
from shardloom.plans import registry


def test_two_batches_are_upserted(spark, monkeypatch, tmp_path):
    calls, upsert = [], M.upsert
    monkeypatch.setattr(M, "upsert", lambda *a: calls.append(a[2]) or upsert(*a))
    rows = "VALUES (1, TIMESTAMP_NTZ '2024-01-01 10:05:00', 'a'), (2, TIMESTAMP_NTZ '2024-01-01 10:06:00', 'b'), (4000, TIMESTAMP_NTZ '2024-01-01 10:07:00', 'a'), (4001, TIMESTAMP_NTZ '2024-01-01 11:00:00', 'a')"
    spark.sql(f"SELECT * FROM ({rows}) t(event_id, ts, event_type)").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["rollup_incremental"](spark, str(tmp_path)).collect()
    assert sorted((x.h.hour, x.event_type, x.n) for x in got) == [(10, "a", 2), (10, "b", 1), (11, "a", 1)]
    assert calls == ["key"]


def test_colocated_merge_has_no_exchange(spark):
    from shardloom.plans import registry
    from tests.compare import SF

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["dml_merge_colocated"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_digests_merge_to_the_digest_of_all_rows(spark):
    """Whatever way rows are dealt, quantiles stay within the compression's error, ends are sharp, nulls count nothing."""
    from pyspark.sql import functions as F

    from shardloom.operators import tdigest as T

    rows = [(k, float((i * 7919) % 10007)) for k in ("a", None) for i in range(10007)] + [("a", None), ("b", None), ("c", float("nan")), ("d", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    two = T.merge(T.tdigest(df.where("v < 3000"), ["k"], "v").unionAll(T.tdigest(df.where("v >= 3000"), ["k"], "v")), ["k"], "digest")
    for got in (T.tdigest(df, ["k"], "v"), two):
        d = F.col("digest")
        by = {x.k: x for x in got.select("k", T.weight(d).alias("n"), T.percentile(d, F.array(*map(F.lit, [0.01, 0.5, 0.99]))).alias("q"), T.percentile_of(d, F.array(*map(F.lit, [-1.0, 5003.0, 20000.0]))).alias("r")).collect()}
        assert set(by) == {"a", None, "d"} and by["d"].q == [4.0] * 3 and by["d"].n == 1
        for k in ("a", None):
            assert by[k].n == 10007
            assert all(abs(x - q * 10007) < 150 for x, q in zip(by[k].q, [0.01, 0.5, 0.99]))
            assert by[k].r[0] == 0 and by[k].r[2] == 1 and abs(by[k].r[1] - 0.5) < 0.02


def test_results_over_the_limit_leave_nothing(spark):
    import pytest

    from shardloom.sources import intermediate as I

    with pytest.raises(ValueError):
        I.create_intermediate_result("too-large", spark.range(10_000), 100)
    with pytest.raises(KeyError):
        I.read_intermediate_result(spark, "too-large")
