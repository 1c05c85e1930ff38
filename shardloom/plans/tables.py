"""User functions, table placement, shards, tenants and statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.operators import tables as P
from shardloom.operators.joins import reference_join


def register(r) -> None:
    @r.pair("udf_sql", "SELECT n_nationkey, n_nationkey * 10 + n_regionkey AS v FROM nation")
    def _sql(spark, sf):
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION two_keys(a INT, b INT) RETURNS INT RETURN a * 10 + b")
        table(spark, sf, "nation").createOrReplaceTempView("nation")
        return spark.sql("SELECT n_nationkey, two_keys(n_nationkey, n_regionkey) AS v FROM nation")

    @r.pair("udf_pandas", "SELECT p_partkey, length(p_name) * 2 AS v FROM part")
    def _pandas(spark, sf):
        @F.pandas_udf("long")
        def double_length(s: pd.Series) -> pd.Series:
            return s.str.len() * 2

        return table(spark, sf, "part").select("p_partkey", double_length("p_name").alias("v"))

    @r.pair("udf_pandas_agg", "SELECT n_regionkey, CAST(max(n_nationkey) - min(n_nationkey) AS BIGINT) AS spread FROM nation GROUP BY n_regionkey")
    def _spread(spark, sf):
        @F.pandas_udf("long")
        def spread(s: pd.Series) -> int:
            return int(s.max() - s.min())

        return table(spark, sf, "nation").groupBy("n_regionkey").agg(spread("n_nationkey").alias("spread"))

    @r.pair("udtf_series", "SELECT n_nationkey, CAST(unnest(generate_series(1, n_regionkey)) AS INT) AS x FROM nation")
    def _series(spark, sf):
        @F.udtf(returnType="x int")
        class UpTo:
            def eval(self, n: int):
                for i in range(1, n + 1):
                    yield (i,)

        spark.udtf.register("up_to", UpTo)
        table(spark, sf, "nation").createOrReplaceTempView("nation")
        return spark.sql("SELECT n_nationkey, x FROM nation, LATERAL up_to(n_regionkey)")

    @r.pair("udf_distributed", "SELECT o_custkey, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
    def _distributed(spark, sf):
        """A function that runs where its key's rows are."""

        def per_key(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"o_custkey": [pdf["o_custkey"].iloc[0]], "n": [int((pdf["o_totalprice"] > 100000).sum())]})

        return table(spark, sf, "orders").select("o_custkey", "o_totalprice").groupBy("o_custkey").applyInPandas(per_key, "o_custkey long, n long")

    @r.pair("run_on_shards", "SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS most FROM orders GROUP BY o_orderstatus")
    def _shards(spark, sf):
        """A command for each shard, and its answers, combined."""
        P.distribute(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice"), "t_command", "o_custkey", 4)
        told = P.run_command_on_shards(spark, "t_command", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM %s GROUP BY o_orderstatus")
        return told.groupBy("o_orderstatus").agg(F.sum("n").alias("n"), F.round(F.max("most"), 2).alias("most"))

    @r.pair("shard_hiding", "SELECT 't_hidden' AS table_name, CAST(3 AS BIGINT) AS shards, count(*) AS n FROM customer")
    def _hiding(spark, sf):
        """Shards can be asked for by name; the catalog lists their table alone."""
        P.distribute(table(spark, sf, "customer").select("c_custkey"), "t_hidden", "c_custkey", 3)
        told = P.run_command_on_shards(spark, "t_hidden", "SELECT count(*) AS n FROM %s").agg(F.count("*").alias("shards"), F.sum("n").alias("n"))
        return P.catalog_tables(spark, "t_hidden").select("table_name").crossJoin(told)

    @r.pair("rebalance_shards", "SELECT true AS moved, true AS even, count(*) AS n FROM orders")
    def _shards_moved(spark, sf):
        """All shards of a stored table lie on one of three nodes; after the moves no node holds over its share and one shard."""
        P.distribute(table(spark, sf, "orders").select("o_custkey"), "t_balance", "o_custkey", 12)
        shards = P.catalog_shards(spark, "t_balance").select(F.col("shard").cast("string").alias("shard"), F.lit("a").alias("node"), "n")
        sizes = [(s.shard, s.node, float(s.n)) for s in shards.collect()]  # a row for each shard
        moves = P.rebalance_plan(sizes, ["a", "b", "c"])
        nodes = P.apply_moves(shards, moves).groupBy("node").agg(F.sum("n").alias("n"), F.max("n").alias("largest"))
        return nodes.agg(F.lit(len(moves) > 0).alias("moved"), ((F.count("*") == 3) & (F.max("n") <= F.sum("n") / 3 + F.max("largest"))).alias("even"), F.sum("n").alias("n"))

    @r.pair("table_distribute", "SELECT 'o_custkey' AS k, 4 AS buckets, count(*) AS n FROM orders")
    def _distribute(spark, sf):
        P.distribute(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "t_orders", "o_custkey", 4)
        key, n = P.bucket_spec(spark, "t_orders")
        return P.distributed(spark, "t_orders").agg(F.count("*").alias("n")).select(F.lit(key).alias("k"), F.lit(n).alias("buckets"), "n")

    @r.pair("reference_table", "SELECT 'reference' AS kind, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
    def _reference(spark, sf):
        P.create_reference_table(table(spark, sf, "nation"), "ref_nation")
        kind = P.catalog_tables(spark, "ref_nation").first().kind
        n = reference_join(table(spark, sf, "customer"), spark.table("ref_nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return n.groupBy("n_name").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n_name", "n")

    @r.pair("table_colocation", "SELECT true AS same, false AS other")
    def _colocation(spark, sf):
        P.distribute(table(spark, sf, "orders").select("o_custkey"), "t_a", "o_custkey", 4)
        P.distribute(table(spark, sf, "customer").select("c_custkey"), "t_b", "c_custkey", 0, colocate_with="t_a")
        P.redistribute(spark, "t_b", "t_c", "c_custkey", 6)
        return spark.createDataFrame([(P.colocated(spark, "t_a", "t_b"), P.colocated(spark, "t_a", "t_c"))], "same boolean, other boolean")

    @r.pair("table_undistribute", "SELECT count(*) AS n FROM customer")
    def _undistribute(spark, sf):
        P.distribute(table(spark, sf, "customer").select("c_custkey"), "t_d", "c_custkey", 4)
        P.undistribute(spark, "t_d", "t_plain")
        return spark.table("t_plain").agg(F.count("*").alias("n"))

    @r.pair("shard_lookup", "SELECT o_custkey, count(*) AS n, true AS found FROM orders GROUP BY o_custkey")
    def _lookup(spark, sf):
        """All rows of a key lie in the stored file of the bucket that its hash gives."""
        P.distribute(table(spark, sf, "orders").select("o_custkey"), "t_lookup", "o_custkey", 8)
        rows = P.distributed(spark, "t_lookup").select("o_custkey", P.bucket_of_file(F.input_file_name()).alias("b"))
        return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_and(F.col("b") == P.shard_of(F.col("o_custkey"), 8)).alias("found"))

    @r.pair("shard_ranges", "SELECT CAST(i AS INT) AS shard, i * 1073741824 - 2147483648 AS min_token, CASE WHEN i = 3 THEN 2147483647 ELSE (i + 1) * 1073741824 - 2147483649 END AS max_token FROM generate_series(0, 3) t(i)")
    def _ranges(spark, sf):
        return P.token_ranges(spark, 4)

    @r.pair("shard_split_points", "SELECT CAST(o_orderkey > 3000 AS INT) + CAST(o_orderkey > 9000 AS INT) AS shard, count(*) AS n FROM orders GROUP BY 1")
    def _split(spark, sf):
        return P.split_by_points(table(spark, sf, "orders"), "o_orderkey", [9000, 3000]).groupBy("shard").agg(F.count("*").alias("n"))

    @r.pair("shard_split_even", "SELECT true AS even")
    def _even(spark, sf):
        o = table(spark, sf, "orders")
        parts = P.split_by_points(o, "o_orderkey", P.split_points(o, "o_orderkey", 4)).groupBy("shard").agg(F.count("*").alias("n"))
        return parts.agg((F.max("n") <= F.min("n") * 1.1).alias("even"))

    @r.pair("tenant_isolation", "SELECT CAST(CASE WHEN user_id = 8 THEN 1 ELSE 0 END AS BOOLEAN) AS own, count(*) AS n FROM events GROUP BY 1")
    def _isolate(spark, sf):
        return P.isolate(table(spark, sf, "events"), "user_id", 8, 16).groupBy((F.col("shard") == 16).alias("own")).agg(F.count("*").alias("n"))

    @r.pair("tenant_top", "SELECT user_id, round(sum(pow(0.5, epoch(last) - epoch(ts)) ), 6) AS score, count(*) AS n FROM (SELECT user_id, date_trunc('day', ts) AS ts, max(date_trunc('day', ts)) OVER () AS last FROM events) t GROUP BY user_id ORDER BY score DESC, user_id LIMIT 5")
    def _tenants(spark, sf):
        return P.tenant_scores(table(spark, sf, "events").withColumn("ts", F.date_trunc("day", "ts")), "user_id", "ts", 1.0, 5)

    @r.pair("rebalance", "SELECT * FROM (VALUES ('s3', 'a', 'b'), ('s2', 'a', 'c'), ('s4', 'b', 'a')) t(shard, source, target)")
    def _rebalance(spark, sf):
        sizes = [("s1", "a", 4.0), ("s2", "a", 4.0), ("s3", "a", 5.0), ("s4", "b", 1.0), ("s5", "c", 2.0)]
        return spark.createDataFrame(P.rebalance_plan(sizes, ["a", "b", "c"]), "shard string, source string, target string")

    @r.pair("constraint_foreign_key", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 1000)")
    def _foreign(spark, sf):
        return P.foreign_key_violations(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").where("c_custkey < 1000"), "c_custkey").agg(F.count("*").alias("n"))

    @r.pair("query_statistics", "SELECT count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS most FROM orders")
    def _statistics(spark, sf):
        """Counters taken while a query runs."""
        seen = Observation("orders")
        table(spark, sf, "orders").observe(seen, F.count("*").alias("n"), F.max("o_orderkey").alias("most")).write.format("noop").mode("overwrite").save()
        return spark.createDataFrame([(seen.get["n"], seen.get["most"])], "n long, most long")

    @r.pair("table_statistics", "SELECT count(*) AS n FROM customer")
    def _analyze(spark, sf):
        """ANALYZE, and the row count that the catalog then holds."""
        P.save_table(table(spark, sf, "customer"), "t_stats")
        spark.sql("ANALYZE TABLE t_stats COMPUTE STATISTICS FOR ALL COLUMNS")
        told = {x.col_name: x.data_type for x in spark.sql("DESCRIBE EXTENDED t_stats").collect()}
        return spark.createDataFrame([(int(told["Statistics"].split(",")[1].split()[0]),)], "n long")

    @r.pair("explain", "SELECT true AS pushed, true AS pruned")
    def _explain(spark, sf):
        """EXPLAIN: the filter reaches the scan, and two of eleven columns are read."""
        df = table(spark, sf, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_quantity")
        plan = df._jdf.queryExecution().simpleString()
        return spark.createDataFrame([("GreaterThan(l_quantity" in plan, "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan)], "pushed boolean, pruned boolean")

    @r.pair("schema_per_tenant", "SELECT 'tenant_a' AS tenant, count(*) AS n FROM nation UNION ALL SELECT 'tenant_b', count(*) FROM region")
    def _schemas(spark, sf):
        """A namespace for each tenant."""
        out = None
        for tenant, t in (("tenant_a", "nation"), ("tenant_b", "region")):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {tenant}")
            P.save_table(table(spark, sf, t), f"{tenant}.data")
            one = spark.table(f"{tenant}.data").agg(F.count("*").alias("n")).select(F.lit(tenant).alias("tenant"), "n")
            out = one if out is None else out.unionAll(one)
        return out
