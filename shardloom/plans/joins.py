"""Joins: logical kinds, and the strategies by placement of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.operators.joins import overlap_join, range_join, reference_join, salted_join
from shardloom.operators.tables import distribute, distributed


def register(r) -> None:
    r.sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
    r.sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
    r.sql("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 400000")
    r.sql("join_full", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 8) b ON a.n_nationkey = b.n_nationkey")
    r.sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
    r.sql("join_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
    r.sql("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
    r.sql("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
    r.sql("join_theta", "SELECT a.n_nationkey AS a_key, b.r_regionkey AS b_key FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 5")
    r.sql("join_between", "SELECT s_suppkey, r_regionkey FROM supplier JOIN region ON s_acctbal BETWEEN r_regionkey * 1000 AND r_regionkey * 1000 + 999")
    r.sql("join_expr", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey")
    r.sql("join_or_condition", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey")
    r.sql("join_null_keys", "SELECT a.x AS ax, b.x AS bx FROM (VALUES (1), (2), (NULL)) a(x) FULL JOIN (VALUES (2), (3), (NULL)) b(x) ON a.x = b.x")
    r.sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 450000)")
    r.sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 300000)")
    r.sql("join_lateral", "SELECT r_name, n_name FROM region LEFT JOIN LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name DESC LIMIT 2) t ON true")
    r.sql("join_values", "SELECT n_nationkey, tag FROM nation JOIN (VALUES (1, 'one'), (2, 'two'), (30, 'none')) t(k, tag) ON n_nationkey = k")
    r.sql("join_function", "SELECT n_nationkey, g FROM nation JOIN (SELECT explode(sequence(20, 30)) AS g) t ON n_nationkey = g", "SELECT n_nationkey, CAST(g AS INT) AS g FROM nation JOIN generate_series(20, 30) t(g) ON n_nationkey = g")
    r.sql("join_recurring_outer", "SELECT r_name, n FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey) t ON n_regionkey = r_regionkey")
    r.sql("join_multiway_order", "SELECT r_name, count(*) AS n FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY r_name")
    r.sql("join_subqueries", "SELECT a.o_custkey, a.n, b.total FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) a JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) b ON a.o_custkey = b.o_custkey")

    @r.pair("join_broadcast_reference", "SELECT n_name, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
    def _reference(spark, sf_dir):
        out = reference_join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return out.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))

    @r.pair("join_colocated", "SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
    def _colocated(spark, sf_dir):
        """Both tables bucketed by the order's key: the join has no exchange."""
        distribute(table(spark, sf_dir, "orders"), "co_orders", "o_orderkey", 8)
        distribute(table(spark, sf_dir, "lineitem"), "co_lineitem", "l_orderkey", 8)
        out = distributed(spark, "co_orders").join(distributed(spark, "co_lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))

    @r.pair("join_single_repartition", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
    def _single(spark, sf_dir):
        """One side lies in buckets of the join key; only the other is shuffled."""
        distribute(table(spark, sf_dir, "customer"), "co_customer", "c_custkey", 8)
        out = table(spark, sf_dir, "orders").join(distributed(spark, "co_customer"), F.col("o_custkey") == F.col("c_custkey"))
        return out.groupBy("c_mktsegment").agg(F.count("*").alias("n"))

    @r.pair("join_dual_repartition", "SELECT l_partkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE p_size < 5 GROUP BY l_partkey")
    def _dual(spark, sf_dir):
        li, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
        out = li.hint("shuffle_hash").join(p.where("p_size < 5"), F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        return out.groupBy("l_partkey").agg(F.count("*").alias("n"))

    @r.pair("join_range_repartition", "SELECT a.o_orderkey, b.o_custkey FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey")
    def _ranged(spark, sf_dir):
        o = table(spark, sf_dir, "orders").alias("a")
        return o.select("o_orderkey").repartitionByRange("o_orderkey").join(o.select("o_orderkey", "o_custkey").repartitionByRange("o_orderkey"), "o_orderkey")

    @r.pair("join_range_bins", "SELECT event_id, lo FROM events JOIN (SELECT i * 7.5 AS lo, i * 7.5 + 5.0 AS hi FROM generate_series(0, 20) t(i)) b ON value >= lo AND value < hi")
    def _bins(spark, sf_dir):
        bands = spark.range(21).select((F.col("id") * F.lit(7.5)).alias("lo"), (F.col("id") * F.lit(7.5) + 5.0).alias("hi"))
        return range_join(table(spark, sf_dir, "events"), bands, "value", "lo", "hi", 5.0).select("event_id", "lo")

    @r.pair("join_range_overlap", "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_acctbal < b.s_acctbal + 5.0 AND b.s_acctbal < a.s_acctbal + 5.0")
    def _overlap(spark, sf_dir):
        """Ranges of balances that overlap, without comparing every pair."""
        side = lambda p: table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(f"{p}_key"), F.col("s_acctbal").alias(f"{p}_lo"), (F.col("s_acctbal") + 5.0).alias(f"{p}_hi"))
        return overlap_join(side("a"), side("b"), ("a_lo", "a_hi"), ("b_lo", "b_hi"), 5.0).where("a_key < b_key").select("a_key", "b_key")

    @r.pair("join_salted", "SELECT event_type, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM events JOIN (VALUES ('click', 1), ('view', 2), ('error', 3)) t(e, w) ON event_type = e GROUP BY event_type")
    def _salted(spark, sf_dir):
        weights = spark.createDataFrame([("click", 1), ("view", 2), ("error", 3)], "event_type string, w long")
        return salted_join(table(spark, sf_dir, "events"), weights, "event_type", row_key=F.col("event_id")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("w").alias("w"))

    @r.pair("join_local_distributed", "SELECT k, count(*) AS n FROM orders JOIN (VALUES (1), (2), (3)) t(k) ON o_custkey = k GROUP BY k")
    def _local(spark, sf_dir):
        local = spark.createDataFrame([(1,), (2,), (3,)], "k int")
        return reference_join(table(spark, sf_dir, "orders").select("o_custkey"), local, F.col("o_custkey") == F.col("k")).groupBy("k").agg(F.count("*").alias("n"))
