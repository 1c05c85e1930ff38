"""Projection, filters, predicates and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.functions.text import array_contains_all, similar_to


def register(r) -> None:
    r.sql("scan_project_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount = 0.05")
    r.sql("project_expressions", "SELECT o_orderkey, o_custkey + 1 AS next_cust, o_totalprice * 2 AS doubled, -o_custkey AS neg FROM orders")
    r.sql("filter_key_equality", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
    r.sql("prune_range", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_orderkey <> 500")
    r.sql("prune_or_in", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (3, 5, 8, 13) OR (o_orderkey > 990 AND o_orderkey < 1000)")
    r.sql("filter_always_false", "SELECT o_orderkey, o_orderstatus FROM orders WHERE 1 = 0")
    r.sql("filter_and_or_not", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'MACHINERY') AND (c_nationkey >= 3 AND c_nationkey <= 17)")
    r.sql("predicates_null", "SELECT id, v IS NULL AS is_null, v IS NOT NULL AS is_not_null FROM (VALUES (1, 10), (2, NULL), (3, 30)) t(id, v)")
    r.sql("distinct_from", "SELECT a, b, a IS DISTINCT FROM b AS differs, a IS NOT DISTINCT FROM b AS same FROM (VALUES (1, 1), (1, 2), (1, NULL), (NULL, NULL)) t(a, b)")
    r.sql("between", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1998-01-01 00:00:00' AND TIMESTAMP '1998-01-20 00:00:00'")
    r.sql("in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 5, 24)")
    r.sql("any_array", "SELECT n_nationkey FROM nation WHERE array_contains(array(2, 4, 6), n_nationkey)", "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY([2, 4, 6])")
    r.sql("case_coalesce", "SELECT id, coalesce(a, b, -1) AS c, nullif(a, 2) AS n, CASE WHEN a > 1 THEN 'big' WHEN a IS NULL THEN 'none' ELSE 'small' END AS k FROM (VALUES (1, 1, 5), (2, 2, 6), (3, NULL, 7), (4, NULL, NULL)) t(id, a, b)")
    r.sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state FROM orders")
    r.sql("greatest_least", "SELECT id, greatest(a, b) AS g, least(a, b) AS l FROM (VALUES (1, 1, 5), (2, NULL, 6), (3, 9, 7)) t(id, a, b)")
    r.sql("like_ilike_regex", r"SELECT p_partkey, p_name LIKE '%ring' AS lk, p_name ILIKE '%RING' AS il, p_name NOT LIKE 's%' AS nl, regexp_like(p_name, '^(red|blue)') AS rx FROM part", r"SELECT p_partkey, p_name LIKE '%ring' AS lk, p_name ILIKE '%RING' AS il, p_name NOT LIKE 's%' AS nl, regexp_matches(p_name, '^(red|blue)') AS rx FROM part")
    r.sql("regex_case_insensitive", "SELECT p_partkey FROM part WHERE regexp_like(p_name, '(?i)^RED')", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^RED', 'i')")
    r.sql("casts", "SELECT CAST('12' AS INT) AS i, CAST(12.7 AS BIGINT) AS l, CAST(5 AS STRING) AS s, CAST('1998-02-03' AS DATE) AS d, CAST(1 AS BOOLEAN) AS b, CAST('3.25' AS DOUBLE) AS f", "SELECT CAST('12' AS INT) AS i, CAST(trunc(12.7) AS BIGINT) AS l, CAST(5 AS VARCHAR) AS s, CAST('1998-02-03' AS DATE) AS d, CAST(1 AS BOOLEAN) AS b, CAST('3.25' AS DOUBLE) AS f")
    r.sql("row_in", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, 'F' FROM customer WHERE c_nationkey = 4)")
    r.sql("row_comparison", "SELECT o_orderkey FROM orders WHERE struct(o_custkey, o_orderkey) < named_struct('o_custkey', 20L, 'o_orderkey', 1000L)", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) < (20, 1000)")
    r.sql("order_by_collation", "SELECT x FROM (VALUES ('b'), ('A'), ('a')) t(x) WHERE x COLLATE UTF8_LCASE = 'A'", "SELECT x FROM (VALUES ('b'), ('A'), ('a')) t(x) WHERE x COLLATE NOCASE = 'A'")

    @r.pair("similar_to", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(red|blue) .*')")
    def _similar(spark, sf_dir):
        return table(spark, sf_dir, "part").where(similar_to(F.col("p_name"), "(red|blue) %")).select("p_partkey")

    @r.pair("array_containment", "SELECT n_nationkey, list_has_all([n_regionkey, n_nationkey, 3], [3, n_nationkey]) AS holds, list_has_all([3], [n_nationkey]) AS within FROM nation")
    def _contains(spark, sf_dir):
        a = F.array("n_regionkey", "n_nationkey", F.lit(3))
        return table(spark, sf_dir, "nation").select("n_nationkey", array_contains_all(a, F.array(F.lit(3), "n_nationkey")).alias("holds"), array_contains_all(F.array(F.lit(3)), F.array("n_nationkey")).alias("within"))

    @r.pair("prepared_statement", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 5000")
    def _prepared(spark, sf_dir):
        return spark.sql("SELECT c_custkey, c_name FROM {customer} WHERE c_nationkey = :nation AND c_acctbal > :least", args={"nation": 7, "least": 5000}, customer=table(spark, sf_dir, "customer"))

    @r.pair("policy_view", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 11")
    def _policy(spark, sf_dir):
        """A row-level policy: users see a view that holds the policy's predicate."""
        table(spark, sf_dir, "orders").where("o_custkey = 11").createOrReplaceTempView("own_orders")
        return spark.sql("SELECT o_orderkey, o_totalprice FROM own_orders")

    @r.pair("stable_function_once", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS moments FROM nation")
    def _stable(spark, sf_dir):
        """now() is one moment for all rows of a query."""
        return table(spark, sf_dir, "nation").select(F.current_timestamp().alias("t")).agg(F.count("*").alias("n"), F.count_distinct("t").alias("moments"))
