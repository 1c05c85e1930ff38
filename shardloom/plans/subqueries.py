"""Common table expressions, subqueries, views and recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.operators.tables import save_table
from shardloom.operators.rewrites import greater_than_all, greater_than_any, recursive_union
from shardloom.sources.intermediate import shared_folder


def register(r) -> None:
    r.sql("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
    r.sql("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
    r.sql("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
    r.sql("anti_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
    r.sql("anti_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT x FROM (VALUES (1), (NULL)) t(x))")
    r.sql("corr_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
    r.sql("corr_exists_noneq", "SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_totalprice > a.o_totalprice + 300000)")
    r.sql("scalar_in_target", "SELECT n_name, (SELECT count(*) FROM region) AS regions FROM nation")
    r.sql("scalar_in_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
    r.sql("subquery_from", "SELECT k, n FROM (SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 10) q WHERE n > 10")
    r.sql("subquery_repartition", "SELECT max(n) AS most, min(n) AS least FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) q")
    r.sql("cte_inline", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 400000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
    r.sql("cte_chained", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS c FROM a GROUP BY n) SELECT b.n, c FROM b WHERE c > 3")
    r.sql("cte_nested", "WITH a AS (WITH b AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT k, n FROM b WHERE k > 0) SELECT r_name, n FROM a JOIN region ON r_regionkey = k")
    r.sql("cte_reused", "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT a.k FROM t a WHERE a.s = (SELECT max(s) FROM t)")
    r.sql("cte_recursive_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
    r.sql("cte_recursive_tree", "WITH RECURSIVE t(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n_nationkey, depth + 1 FROM nation JOIN t ON n_nationkey = k * 2 OR n_nationkey = k * 2 + 1 WHERE depth < 4) SELECT k, depth FROM t")

    @r.pair("lateral_topn", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer) c JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t ON true")
    def _lateral(spark, sf_dir):
        """The ordered columns stay in the inner list: Spark ranks by them only there, else it rests on a sort that the next shuffle undoes."""
        table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
        table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
        return spark.sql("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer) c JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 2) t ON true")

    @r.pair("cte_recursive_distinct", "WITH RECURSIVE t(k) AS (SELECT 3 UNION SELECT (k * 7 + 5) % 25 FROM t) SELECT k FROM t")
    def _distinct(spark, sf_dir):
        step = lambda new: new.select(((F.col("k") * 7 + 5) % 25).alias("k"))
        return recursive_union(spark.createDataFrame([(3,)], "k int"), step, shared_folder(spark, "recursive"))

    @r.pair("quantified_all", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT o_totalprice FROM orders WHERE o_custkey < 3)")
    def _all(spark, sf_dir):
        o = table(spark, sf_dir, "orders")
        return greater_than_all(o.select("o_orderkey", "o_totalprice"), "o_totalprice", o.where("o_custkey < 3").select(F.col("o_totalprice").alias("x")), "x").select("o_orderkey")

    @r.pair("quantified_all_correlated", "SELECT o_orderkey FROM orders a WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders b WHERE b.o_custkey = a.o_custkey)")
    def _all_correlated(spark, sf_dir):
        o = table(spark, sf_dir, "orders")
        other = o.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("x"))
        return o.join(other, (F.col("o_custkey") == F.col("k")) & ~F.coalesce(F.col("o_totalprice") >= F.col("x"), F.lit(False)), "left_anti").select("o_orderkey")

    @r.pair("quantified_any", "SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_custkey < 5)")
    def _any(spark, sf_dir):
        return greater_than_any(table(spark, sf_dir, "supplier"), "s_acctbal", table(spark, sf_dir, "customer").where("c_custkey < 5"), "c_acctbal").select("s_suppkey")

    @r.pair("cte_materialized", "WITH t AS MATERIALIZED (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k, a.n FROM t a JOIN t b ON a.n = b.n + 20")
    def _materialized(spark, sf_dir):
        """Computed once, written, and read twice."""
        from shardloom.sources.intermediate import create_intermediate_result, read_intermediate_result

        t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
        create_intermediate_result("cte_materialized", t)
        a, b = read_intermediate_result(spark, "cte_materialized"), read_intermediate_result(spark, "cte_materialized")
        return a.join(b.select(F.col("n").alias("m")), F.col("n") == F.col("m") + 20).select("k", "n")

    @r.pair("view_nested", "SELECT n_name, n FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) v JOIN nation ON n_nationkey = s_nationkey WHERE n > 2")
    def _view(spark, sf_dir):
        table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
        table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
        spark.sql("CREATE OR REPLACE TEMP VIEW per_nation AS SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
        spark.sql("CREATE OR REPLACE TEMP VIEW named_nations AS SELECT n_name, n FROM per_nation JOIN nation ON n_nationkey = s_nationkey")
        return spark.sql("SELECT * FROM named_nations WHERE n > 2")

    @r.pair("materialized_view", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
    def _matview(spark, sf_dir):
        """Stored as a table; a refresh writes it anew."""
        save_table(table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), "mv_status")
        return spark.table("mv_status")


