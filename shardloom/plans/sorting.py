"""Order, limits, ties and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.operators.rewrites import approximate_top, with_ties


def register(r) -> None:
    v = "(VALUES (1, 3), (2, NULL), (3, 1), (4, NULL), (5, 2)) t(id, v)"
    r.sql("order_nulls_first", f"SELECT id, v FROM (SELECT id, v FROM {v} ORDER BY v ASC NULLS FIRST, id LIMIT 3) x")
    r.sql("order_nulls_last", f"SELECT id, v FROM (SELECT id, v FROM {v} ORDER BY v DESC NULLS LAST, id LIMIT 3) x")
    r.sql("order_expressions", "SELECT o_orderkey FROM orders ORDER BY o_totalprice % 1000 DESC, abs(o_custkey - 500), o_orderkey LIMIT 25")
    r.sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
    r.sql("limit_all", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT ALL")
    r.sql("topk_aggregate", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 10")
    r.sql("limit_pushdown", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 5")
    r.sql("union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
    r.sql("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
    r.sql("intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
    r.sql("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
    r.sql("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
    r.sql("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
    r.sql("set_nested", "(SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region) UNION (SELECT c_nationkey FROM customer INTERSECT SELECT 3)")
    r.sql("set_local", "SELECT o_custkey AS k FROM orders UNION SELECT x FROM (VALUES (1), (2)) t(x)")
    r.sql("set_aggregate", "SELECT side, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM (SELECT 'c' AS side, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier) u GROUP BY side")

    @r.pair("fetch_with_ties", "SELECT n_nationkey, n_regionkey FROM (SELECT n_nationkey, n_regionkey, rank() OVER (ORDER BY n_regionkey) AS k FROM nation) t WHERE k <= 7")
    def _ties(spark, sf_dir):
        return with_ties(table(spark, sf_dir, "nation"), "n_regionkey", 7).select("n_nationkey", "n_regionkey")

    @r.pair("fetch_with_ties_desc", "SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate, rank() OVER (ORDER BY o_orderdate DESC) AS k FROM orders) t WHERE k <= 3")
    def _ties_desc(spark, sf_dir):
        return with_ties(table(spark, sf_dir, "orders"), "o_orderdate", 3, descending=True).select("o_orderkey", "o_orderdate")

    @r.pair("limit_approximate_exact", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
    def _approximate(spark, sf_dir):
        """Each task's best twelve hold the twelve best."""
        return approximate_top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 12, 12)
