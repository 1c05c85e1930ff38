"""Decision-support queries over the star schema."""

from __future__ import annotations


def register(r) -> None:
    r.sql(
        "tpch_q1",
        """
        SELECT l_returnflag, l_linestatus,
               round(sum(l_quantity), 2) AS sum_qty,
               round(sum(l_extendedprice), 2) AS sum_base_price,
               round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
               round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
               round(avg(l_quantity), 4) AS avg_qty,
               round(avg(l_extendedprice), 4) AS avg_price,
               round(avg(l_discount), 4) AS avg_disc,
               count(*) AS count_order
        FROM lineitem
        WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
        GROUP BY l_returnflag, l_linestatus
        """,
    )
    r.sql(
        "tpch_q3",
        """
        SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate
        ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
        """,
    )
    r.sql(
        "tpch_q5",
        """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
             JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
             JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'
        GROUP BY n_name
        """,
    )
    r.sql(
        "tpch_q6",
        """
        SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
          AND l_discount BETWEEN 0.04 AND 0.08 AND l_quantity < 24
        """,
    )
    q7 = """
        SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
            SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, extract(year FROM l_shipdate) AS l_year,
                   l_extendedprice * (1 - l_discount) AS volume
            FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
                 JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
            WHERE n1.n_nationkey < 5 AND n2.n_nationkey BETWEEN 5 AND 9
        ) shipping GROUP BY supp_nation, cust_nation, l_year
        """
    r.sql("tpch_q7", q7)
    r.sql(
        "tpch_q7_nested",
        """
        SELECT n_name, l_year, round(sum(volume), 4) AS revenue FROM (
            SELECT n_name, extract(year FROM l_shipdate) AS l_year, l_extendedprice * (1 - l_discount) AS volume
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
                 JOIN (SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%') n ON s_nationkey = n_nationkey
        ) x GROUP BY n_name, l_year
        """,
    )
    r.sql(
        "tpch_q10",
        """
        SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_returnflag = 'R'
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
        """,
    )
    r.sql(
        "tpch_q12_priority",
        """
        SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
               CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate GROUP BY l_linestatus
        """,
    )
    r.sql(
        "tpch_q14",
        """
        SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey
        """,
    )
    r.sql(
        "tpch_q19_or",
        """
        SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 25)
           OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 40)
           OR (p_brand = 'Brand#7' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 50)
        """,
    )
    ch(r)


def ch(r) -> None:
    """Shapes of the mixed analytical workload that the star schema can carry."""
    r.sql("ch_q1", "SELECT l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_amount, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-02 00:00:00' GROUP BY l_linenumber")
    r.sql("ch_q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate) GROUP BY o_orderpriority")
    r.sql("ch_q8", "SELECT extract(year FROM o_orderdate) AS l_year, round(sum(CASE WHEN n_name = 'NATION_7' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS mkt_share FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY extract(year FROM o_orderdate)")
    r.sql("ch_q9", "SELECT n_name, extract(year FROM o_orderdate) AS l_year, round(sum(l_extendedprice), 2) AS sum_profit FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE p_name LIKE '%ring' GROUP BY n_name, extract(year FROM o_orderdate)")
    r.sql("ch_q11", "SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS ordercount FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 8 GROUP BY l_partkey HAVING sum(l_quantity) > (SELECT sum(l_quantity) * 0.0008 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 8)")
    r.sql("ch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey) c GROUP BY c_count")
    r.sql("ch_q15", "WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice), 2) AS total_revenue FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)")
    r.sql("ch_q16", "SELECT p_brand, p_type, count(DISTINCT l_suppkey) AS supplier_cnt FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_type NOT LIKE 'ECO%' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type")
    r.sql("ch_q17", "SELECT round(sum(l_extendedprice) / 2.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT l_partkey AS k, avg(l_quantity) AS a FROM lineitem GROUP BY l_partkey) t ON k = p_partkey WHERE p_brand = 'Brand#17' AND l_quantity < a")
    r.sql("ch_q18", "SELECT c_custkey, o_orderkey, round(sum(l_extendedprice), 2) AS amount FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey, o_orderkey HAVING sum(l_extendedprice) > 250000")
    r.sql("ch_q20", "SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') GROUP BY l_suppkey HAVING sum(l_quantity) > 500)")
    r.sql("ch_q21", "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey AND l2.l_shipdate > l1.l_shipdate) GROUP BY s_name")
    r.sql("ch_q22", "SELECT substring(c_name, 10, 3) AS country, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY substring(c_name, 10, 3)")
