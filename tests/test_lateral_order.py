"""The best rows of each key through LATERAL: which they are is settled by the order alone."""

from __future__ import annotations

import duckdb

from shardloom.operators.statistics import explain
from shardloom.plans import registry
from tests.compare import rows


def test_lateral_topn_orders_nulls_like_its_sql(spark, tmp_path):
    """Prices that repeat, are null or not a number; orders without a key; customers twice, without orders or without a key."""
    customers = [(1,), (1,), (2,), (3,), (4,), (None,)]
    orders = [(k, c, p) for c, many in {1: [(10, 5.0), (None, 5.0), (11, 5.0)], 2: [(20, None), (21, 1.0), (22, None)], 3: [(30, float("nan")), (31, 9.0), (32, 10.0)], None: [(40, 1.0)]}.items() for k, p in many]
    spark.createDataFrame(customers, "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.queries()["lateral_topn"](spark, str(tmp_path))
    want = c.execute(registry.oracle_sql()["lateral_topn"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())


def test_lateral_topn_ranks_by_the_price(spark):
    """The rank has the order itself; it doesn't rest on a sort below the shuffle."""
    plan = explain(registry.queries()["lateral_topn"](spark, "/root/testdata/sf0.001"))
    ranks = [line for line in plan.splitlines() if "row_number()" in line and "windowspecdefinition" in line]
    assert ranks and all("o_totalprice" in line and "o_orderkey" in line for line in ranks)
    assert "rangepartitioning" not in plan
