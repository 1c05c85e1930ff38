"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.operators.rewrites import groups_frame, sum_excluding_current


def register(r) -> None:
    o = "FROM orders"
    r.sql("win_row_number", f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n {o}")
    r.sql("win_rank", f"SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d {o}")
    r.sql("win_rank_no_order", "SELECT n_nationkey, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY 1) AS d, rank() OVER (PARTITION BY n_regionkey ORDER BY 1) AS r FROM nation", "SELECT n_nationkey, CAST(1 AS BIGINT) AS d, CAST(1 AS BIGINT) AS r FROM nation")
    r.sql("win_percent_cume", f"SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), 6) AS p, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), 6) AS c {o}")
    r.sql("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice) OVER w AS nxt, lag(o_totalprice, 2, 0.0) OVER w AS prev2 {o} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
    r.sql("win_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 {o} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    r.sql("win_ntile", f"SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS q {o}")
    r.sql("win_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) AS c {o}")
    r.sql("win_range_num", "SELECT n_nationkey, count(*) OVER (ORDER BY n_nationkey RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS c FROM nation")
    r.sql("win_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS c FROM orders")
    r.sql("win_aggregates", f"SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS a, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m, count(*) OVER (PARTITION BY o_custkey) AS n {o}")
    r.sql("win_named", f"SELECT o_orderkey, rank() OVER w AS r, count(*) OVER w AS c {o} WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey)")
    r.sql("win_over_agg", "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_custkey")
    r.sql("win_distinct", f"SELECT DISTINCT o_custkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m {o}")
    r.sql("win_nested", "SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, o_totalprice FROM orders) q WHERE rn <= 3 AND o_totalprice > 300000 GROUP BY o_custkey")
    r.sql("win_filter", f"SELECT o_orderkey, count(CASE WHEN o_totalprice > 200000 THEN 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS c {o}", f"SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 200000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS c {o}")
    r.sql("win_topk_per_group", "SELECT n_regionkey, n_name FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation) t WHERE k <= 2")
    r.sql("win_sessions", "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOURS, true) AS gap FROM events) a) b GROUP BY user_id, session", "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOURS, true) AS gap FROM events) a) b GROUP BY user_id, session")
    r.sql("win_funnel", "SELECT user_id, max(step) AS reached FROM (SELECT user_id, CASE WHEN event_type = 'purchase' AND max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w = 1 THEN 3 WHEN event_type = 'click' AND max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w = 1 THEN 2 WHEN event_type = 'view' THEN 1 ELSE 0 END AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) t GROUP BY user_id")

    @r.pair("win_groups", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
    def _groups(spark, sf_dir):
        t, w = groups_frame(Window.partitionBy("o_custkey"), [F.col("o_orderpriority")], table(spark, sf_dir, "orders"), 1, 0, ["o_custkey"])
        return t.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("s"))

    @r.pair("win_exclude", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW), 2) AS s FROM orders")
    def _exclude(spark, sf_dir):
        w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
        return table(spark, sf_dir, "orders").select("o_orderkey", F.round(sum_excluding_current(F.col("o_totalprice"), w, 1, 1), 2).alias("s"))

    @r.pair("win_array_agg", "SELECT n_nationkey, CAST(array_agg(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS VARCHAR) AS a FROM nation")
    def _array(spark, sf_dir):
        a = F.collect_list("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
        return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]")).alias("a"))

    @r.pair("win_rolling_distinct", "SELECT DISTINCT a.day, true AS close FROM (SELECT CAST(ts AS DATE) AS day FROM events) a")
    def _rolling(spark, sf_dir):
        """Distinct users of the last seven days: daily sketches merged over a window, against an exact count."""
        e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id")
        daily = e.groupBy("day").agg(F.hll_sketch_agg("user_id").alias("s"))
        w = Window.orderBy(F.unix_date("day")).rangeBetween(-6, 0)  # one row for each day
        near = daily.select("day", F.hll_sketch_estimate(F.hll_union_agg("s").over(w)).alias("near"))
        spread = e.distinct().select(F.explode(F.sequence("day", F.date_add("day", 6))).alias("d"), "user_id")  # the seven windows that a day is in
        exact = spread.groupBy("d").agg(F.count_distinct("user_id").alias("exact"))
        return near.join(exact, F.col("day") == F.col("d")).select("day", (F.abs(F.col("near") - F.col("exact")) <= 0.1 * F.col("exact") + 1).alias("close"))
