"""Grouping, aggregates and sketches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.operators import aggregates as A
from shardloom.operators import tdigest as T
from shardloom.operators.tables import distribute, distributed
from shardloom.sources.intermediate import shared_folder

#: A table with nulls and repeats: key, val, valf.
#: Group 10 repeats a value, 20 mixes nulls and a negative, 30 is all null, 40 holds a lone zero, the null group one row.
DATA = "(VALUES (101, 10, 6, 0.5), (102, 10, 6, 1.5), (103, 10, 1, 0.25), (104, 20, -4, NULL), (105, 20, NULL, 8.125), (106, 30, NULL, NULL), (107, 30, NULL, NULL), (108, 40, 0, 0.0), (109, NULL, 17, -2.75)) t(id, k, val, valf)"


def register(r) -> None:
    r.sql("agg_group", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY o_orderstatus, o_orderpriority")
    r.sql("agg_global", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders")
    r.sql("agg_global_empty", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
    r.sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND min(o_totalprice) < 50000")
    r.sql("agg_having_subquery", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT avg(s) * 1.5 FROM (SELECT sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) x)")
    r.sql("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS large, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 2) AS low_total FROM orders GROUP BY o_orderstatus")
    r.sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
    r.sql("agg_distinct_multi", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, round(sum(DISTINCT l_quantity), 2) AS qs, round(avg(DISTINCT l_quantity), 4) AS qa, count(*) AS n FROM lineitem GROUP BY l_returnflag")
    r.sql("agg_expr_key", "SELECT o_custkey % 7 AS m, extract(year FROM o_orderdate) AS y, count(*) AS n FROM orders GROUP BY o_custkey % 7, extract(year FROM o_orderdate)")
    r.sql("agg_position_key", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
    r.sql("agg_nulls", f"SELECT k, count(*) AS n, count(val) AS nv, CAST(sum(val) AS BIGINT) AS s, min(val) AS lo, max(val) AS hi, round(avg(val), 4) AS a, round(sum(CAST(valf AS DOUBLE)), 4) AS f FROM {DATA} GROUP BY k")
    r.sql("agg_of_agg", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x GROUP BY n")
    r.sql("grouping_sets", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
    r.sql("cube", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
    r.sql("rollup", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
    r.sql("grouping_function", "SELECT o_orderstatus AS s, o_orderpriority AS p, CAST(grouping(o_orderstatus) AS INT) AS gs, CAST(grouping(o_orderpriority) AS INT) AS gp, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
    r.sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
    r.sql("agg_bool_bit", f"SELECT k, bool_and(val > 1) AS ba, bool_or(val > 3) AS bo, every(id > 0) AS ev, bit_and(id) AS nd, bit_or(id) AS r, bit_xor(id) AS x FROM {DATA} GROUP BY k", f"SELECT k, bool_and(val > 1) AS ba, bool_or(val > 3) AS bo, bool_and(id > 0) AS ev, bit_and(id) AS nd, bit_or(id) AS r, bit_xor(id) AS x FROM {DATA} GROUP BY k")
    r.sql("agg_any_value", "SELECT n_regionkey, any_value(r_name) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
    r.sql("agg_stats", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp, round(stddev(l_quantity), 6) AS s, round(variance(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
    r.sql("agg_corr_regr", "SELECT round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS rs, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ri, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS rc, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay FROM lineitem")
    r.sql("agg_percentiles", "SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS pc, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS pd FROM lineitem GROUP BY l_returnflag")
    r.sql("agg_mode", "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY k) AS m FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS k FROM orders) t GROUP BY o_orderstatus")
    r.sql("agg_min_max_by", "SELECT o_orderstatus, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_orderstatus")
    r.sql("agg_wide_sum", "SELECT CAST(sum(CAST(o_orderkey AS DECIMAL(38, 0))) AS STRING) AS s FROM orders", "SELECT CAST(sum(o_orderkey) AS VARCHAR) AS s FROM orders")
    r.sql("agg_vendor_sum", "SELECT l_suppkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_suppkey")

    @r.pair("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
    def _distinct_on(spark, sf_dir):
        from shardloom.operators.rewrites import distinct_on

        return distinct_on(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])

    @r.pair("agg_string", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names, string_agg(DISTINCT CAST(n_regionkey AS VARCHAR), '-') AS keys FROM nation GROUP BY n_regionkey")
    def _string(spark, sf_dir):
        names = F.array_join(A.array_agg(F.col("n_name"), F.col("n_name"), descending=True), ",")
        return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("names"), F.array_join(F.array_distinct(A.array_agg(F.col("n_regionkey").cast("string"), F.col("n_regionkey"))), "-").alias("keys"))

    @r.pair("agg_array_ordered", f"SELECT k, CAST(array_agg(val ORDER BY id) AS VARCHAR) AS vals FROM {DATA} GROUP BY k")
    def _array(spark, sf_dir):
        t = spark.sql(f"SELECT * FROM {DATA}")
        shown = F.concat(F.lit("["), F.array_join(A.array_agg(F.col("val"), F.col("id")).cast("array<string>"), ", ", "NULL"), F.lit("]"))
        return t.groupBy("k").agg(shown.alias("vals"))

    @r.pair("agg_json", f"SELECT k, CAST(to_json(list(val ORDER BY id)) AS VARCHAR) AS vals FROM {DATA} GROUP BY k")
    def _json(spark, sf_dir):
        return spark.sql(f"SELECT * FROM {DATA}").groupBy("k").agg(A.json_agg(F.col("val"), F.col("id")).alias("vals"))

    @r.pair("agg_json_object", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
    def _json_object(spark, sf_dir):
        return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.json_object_agg(F.col("n_name"), F.col("n_nationkey")).alias("o"))

    @r.pair("agg_colocated", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    def _colocated(spark, sf_dir):
        """Grouped by the bucket key: no exchange."""
        distribute(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "agg_orders", "o_custkey", 8)
        return distributed(spark, "agg_orders").groupBy("o_custkey").agg(F.count("*").alias("n"))

    within = lambda name: "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag" if name == "flag" else "SELECT true AS close"

    @r.pair("approx_distinct", within("flag"))
    def _approx(spark, sf_dir):
        exact, near = F.count_distinct("l_partkey"), F.approx_count_distinct("l_partkey", 0.02)
        return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.abs(near - exact) <= 0.1 * exact).alias("close"))

    @r.pair("hll_rollup", within("one"))
    def _hll(spark, sf_dir):
        """Daily sketches, merged and estimated."""
        daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(A.distinct_sketch(F.col("user_id")).alias("users"))
        exact = table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("exact"))
        return daily.agg(A.distinct_estimate(A.distinct_merge(F.col("users"))).alias("near")).crossJoin(exact).select((F.abs(F.col("near") - F.col("exact")) <= 0.1 * F.col("exact") + 1).alias("close"))

    @r.pair("topn_rollup", "SELECT event_type AS item, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 3")
    def _topn(spark, sf_dir):
        """Daily sketches of frequent items, merged; with fewer kinds than slots the counts are exact."""
        daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(A.top_sketch(F.col("event_type"), 100).alias("s"))
        return daily.agg(A.top_items(A.top_merge(F.col("s"), 100), 3).alias("t")).select(F.inline("t")).select("item", F.col("count").alias("n"))

    @r.pair("tdigest_rollup", within("one"))
    def _digest(spark, sf_dir):
        """Sketches by hour, merged; a quantile and a rank from the merged one."""
        e = table(spark, sf_dir, "events")
        hourly = e.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(A.quantile_sketch(F.col("value")).alias("s"))
        merged = hourly.agg(A.quantile_merge(F.col("s")).alias("s"))
        near = merged.select(A.quantile_of(F.col("s"), 0.9).alias("q"), A.quantile_rank(F.col("s"), 10.0).alias("k"))
        exact = e.agg(A.rank_of(F.col("value"), 10.0).alias("ek"), F.percentile("value", [0.87, 0.93]).alias("eq"))
        return near.crossJoin(exact).select(((F.abs(F.col("k") - F.col("ek")) < 0.03) & F.col("q").between(F.col("eq")[0], F.col("eq")[1])).alias("close"))

    stored = "SELECT event_type, count(value) AS n, true AS close FROM events GROUP BY event_type"

    def digests(spark, sf_dir):
        """Digests by hour and type, stored, read again and merged by type."""
        e = table(spark, sf_dir, "events").withColumn("h", F.date_trunc("hour", "ts"))
        path = shared_folder(spark, "digests")
        T.tdigest(e, ["h", "event_type"], "value").write.parquet(path)
        return e, T.merge(spark.read.parquet(path), ["event_type"], "digest")

    @r.pair("tdigest_quantiles", stored)
    def _quantiles(spark, sf_dir):
        """An array of quantiles of merged digests: each lies between the exact ones two hundredths to either side."""
        e, merged = digests(spark, sf_dir)
        asked = [0.05, 0.25, 0.5, 0.9, 0.97]
        near = merged.select("event_type", F.round(T.weight(F.col("digest"))).cast("long").alias("n"), T.percentile(F.col("digest"), F.array(*map(F.lit, asked))).alias("q"))
        exact = e.groupBy(F.col("event_type").alias("k")).agg(F.percentile("value", [q - 0.02 for q in asked]).alias("lo"), F.percentile("value", [q + 0.02 for q in asked]).alias("hi"))
        fits = F.forall(F.sequence(F.lit(0), F.lit(len(asked) - 1)), lambda i: F.get("q", i).between(F.get("lo", i), F.get("hi", i)))
        return near.join(exact, F.col("event_type") == F.col("k")).select("event_type", "n", fits.alias("close"))

    @r.pair("tdigest_ranks", stored)
    def _ranks(spark, sf_dir):
        """An array of ranks from merged digests, each within two hundredths of the exact share."""
        e, merged = digests(spark, sf_dir)
        asked = [1.0, 5.0, 10.0, 20.0]
        near = merged.select("event_type", F.round(T.weight(F.col("digest"))).cast("long").alias("n"), T.percentile_of(F.col("digest"), F.array(*map(F.lit, asked))).alias("k"))
        exact = e.groupBy(F.col("event_type").alias("t")).agg(F.array(*[A.rank_of(F.col("value"), x) for x in asked]).alias("x"))
        fits = F.forall(F.zip_with("k", "x", lambda a, b: F.abs(a - b) < 0.02), lambda ok: ok)
        return near.join(exact, F.col("event_type") == F.col("t")).select("event_type", "n", fits.alias("close"))

    @r.pair("approx_percentiles", within("flag"))
    def _percentile(spark, sf_dir):
        p, q = F.percentile_approx("l_extendedprice", [0.25, 0.5, 0.75], 10000), F.percentile("l_extendedprice", [0.24, 0.26, 0.49, 0.51, 0.74, 0.76])
        out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(p.alias("p"), q.alias("q"))
        return out.select("l_returnflag", F.forall(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get("p", i).between(F.get("q", i * 2), F.get("q", i * 2 + 1))).alias("close"))

    @r.pair("percentile_of", "SELECT l_returnflag, round(avg(CASE WHEN l_quantity <= 10 THEN 1.0 ELSE 0.0 END), 6) AS p10, round(avg(CASE WHEN l_quantity <= 40 THEN 1.0 ELSE 0.0 END), 6) AS p40 FROM lineitem GROUP BY l_returnflag")
    def _of(spark, sf_dir):
        return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(A.rank_of(F.col("l_quantity"), 10), 6).alias("p10"), F.round(A.rank_of(F.col("l_quantity"), 40), 6).alias("p40"))

    @r.pair("user_aggregate", "SELECT o_orderstatus, round(sqrt(sum(o_totalprice * o_totalprice) / count(*)), 4) AS rms FROM orders GROUP BY o_orderstatus")
    def _user(spark, sf_dir):
        """A user's aggregate in two phases: Arrow batches make partial states (sfunc), a grouped sum combines them."""

        def partial(batches):
            for b in batches:
                g = b.assign(s=b["o_totalprice"] ** 2).groupby("o_orderstatus").agg(s=("s", "sum"), n=("s", "size")).reset_index()
                yield g

        states = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice").mapInPandas(partial, "o_orderstatus string, s double, n long")
        return states.groupBy("o_orderstatus").agg(F.round(F.sqrt(F.sum("s") / F.sum("n")), 4).alias("rms"))

    @r.pair("user_aggregate_ordered", "SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders GROUP BY o_custkey")
    def _gather(spark, sf_dir):
        """An aggregate without a combine step: a grouped pandas function sees all rows of a group, which must fit in one task; so the key is one of many values."""

        @F.pandas_udf("long")
        def top(price: pd.Series, key: pd.Series) -> int:
            best = price.max()
            return int(key[price == best].min())

        return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(top("o_totalprice", "o_orderkey").alias("k"))
