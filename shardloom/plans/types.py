"""Types beyond numbers and text, and catalog helpers."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.functions import ranges as R
from shardloom.operators import tables as P
from shardloom.operators.numbering import number_rows
from shardloom.sources import columnar as C
from shardloom.sources import intermediate as I
from shardloom.sources import timeparts as T
from shardloom.sources.intermediate import shared_folder


def register(r) -> None:
    r.sql("type_numbers", "SELECT CAST(7 AS SMALLINT) AS s, CAST(7 AS INT) AS i, CAST(7 AS BIGINT) AS b, CAST(1.5 AS REAL) AS r, CAST(1.25 AS DOUBLE) AS d, CAST(123.456 AS DECIMAL(10, 2)) AS n")
    r.sql("type_dates", "SELECT DATE '2024-02-29' AS d, TIMESTAMP_NTZ '2024-02-29 01:02:03.5' AS t, CAST(TIMESTAMP_NTZ '2024-02-29 01:02:03.5' AS DATE) AS c", "SELECT DATE '2024-02-29' AS d, TIMESTAMP '2024-02-29 01:02:03.5' AS t, CAST(TIMESTAMP '2024-02-29 01:02:03.5' AS DATE) AS c")
    r.sql("type_bytes", "SELECT hex(encode('é€', 'UTF-8')) AS h, CAST(octet_length(encode('é€', 'UTF-8')) AS BIGINT) AS n, decode(unhex('C3A9'), 'UTF-8') AS s", "SELECT hex(encode('é€')) AS h, CAST(octet_length(encode('é€')) AS BIGINT) AS n, decode(unhex('C3A9')) AS s")
    r.sql("type_bits", "SELECT a & b AS a_, a | b AS o, a ^ b AS x, bit_count(a) AS c FROM (VALUES (12, 10), (255, 1)) t(a, b)", "SELECT a & b AS a_, a | b AS o, xor(a, b) AS x, CAST(bit_count(a) AS INT) AS c FROM (VALUES (12, 10), (255, 1)) t(a, b)")
    r.sql("type_arrays_nested", "SELECT n_nationkey, array(array(1, n_nationkey), array(n_regionkey, 4))[1][0] AS x, CAST(size(flatten(array(array(1, 2), array(n_regionkey)))) AS BIGINT) AS n FROM nation", "SELECT n_nationkey, [[1, n_nationkey], [n_regionkey, 4]][2][1] AS x, CAST(len(flatten([[1, 2], [n_regionkey]])) AS BIGINT) AS n FROM nation")
    r.sql("type_composite", "SELECT s.a AS a, s.b.c AS c FROM (SELECT named_struct('a', n_nationkey, 'b', named_struct('c', n_name)) AS s FROM nation) t", "SELECT s.a AS a, s.b.c AS c FROM (SELECT {'a': n_nationkey, 'b': {'c': n_name}} AS s FROM nation) t")
    r.sql("type_map", "SELECT n_nationkey, map('k', n_regionkey, 'x', 1)['k'] AS v, CAST(size(map_keys(map('k', 1, 'x', 2))) AS BIGINT) AS n FROM nation", "SELECT n_nationkey, MAP {'k': n_regionkey, 'x': 1}['k'] AS v, CAST(cardinality(MAP {'k': 1, 'x': 2}) AS BIGINT) AS n FROM nation")
    r.sql("type_uuid", "SELECT x, x = lower('550E8400-E29B-41D4-A716-446655440000') AS same FROM (VALUES ('550e8400-e29b-41d4-a716-446655440000')) t(x)")
    r.sql("type_boolean", "SELECT a, b, a AND b AS x, a OR b AS y, NOT a AS z FROM (VALUES (true, false), (true, CAST(NULL AS BOOLEAN)), (false, CAST(NULL AS BOOLEAN))) t(a, b)")
    r.sql("type_interval", "SELECT CAST(extract(DAY FROM (TIMESTAMP_NTZ '2024-03-05 00:00:00' - TIMESTAMP_NTZ '2024-02-28 00:00:00')) AS BIGINT) AS days, DATE '2024-01-31' + INTERVAL 1 MONTH AS m", "SELECT date_diff('day', TIMESTAMP '2024-02-28 00:00:00', TIMESTAMP '2024-03-05 00:00:00') AS days, CAST(DATE '2024-01-31' + INTERVAL 1 MONTH AS DATE) AS m")
    r.sql("generated_column", "SELECT o_orderkey, o_totalprice, round(o_totalprice * 0.5, 3) AS half FROM orders")
    r.sql("select_for_update", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3)")

    @r.pair("identity_column", "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey FROM orders")
    def _identity(spark, sf):
        """Numbers without a global window."""
        return number_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey")

    @r.pair("type_enum_order", "SELECT o_orderkey, o_orderstatus, CAST(list_position(['P', 'O', 'F'], o_orderstatus) AS BIGINT) AS k FROM orders ORDER BY k, o_orderkey LIMIT 30")
    def _enum(spark, sf):
        """Labels in order of their declaration."""
        o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", R.enum_rank(F.col("o_orderstatus"), ["P", "O", "F"]).alias("k"))
        return o.orderBy("k", "o_orderkey").limit(30)

    @r.pair("type_range_contains", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20")
    def _contains(spark, sf):
        return table(spark, sf, "part").where(R.contains(R.make_range(F.lit(10), F.lit(20)), F.col("p_size"))).select("p_partkey")

    @r.pair("type_range_overlaps", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND b.n_nationkey < a.n_nationkey + 3")
    def _overlaps(spark, sf):
        n = table(spark, sf, "nation").select("n_nationkey", R.make_range(F.col("n_nationkey"), F.col("n_nationkey") + 3).alias("r"))
        a, b = n.alias("a"), n.alias("b")
        return a.join(b, (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & R.overlaps(F.col("a.r"), F.col("b.r"))).select(F.col("a.n_nationkey").alias("a_key"), F.col("b.n_nationkey").alias("b_key"))

    @r.pair("type_domain", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
    def _domain(spark, sf):
        c = table(spark, sf, "customer").where("c_acctbal >= 0")
        return c.select("c_custkey", R.domain(F.col("c_acctbal"), F.col("c_acctbal") >= 0, "positive").alias("c_acctbal"))

    @r.pair("catalog_tables", "SELECT * FROM (VALUES ('cat_a', 'distributed', 'o_custkey', 4), ('cat_b', 'plain', NULL, NULL)) t(table_name, kind, distribution_column, shard_count)")
    def _catalog(spark, sf):
        P.distribute(table(spark, sf, "orders").select("o_custkey"), "cat_a", "o_custkey", 4)
        P.undistribute(spark, "cat_a", "cat_b")
        return P.catalog_tables(spark, "cat_")

    @r.pair("catalog_shards", "SELECT CAST(4 AS BIGINT) AS shards, count(*) AS n FROM orders")
    def _shards(spark, sf):
        P.distribute(table(spark, sf, "orders").select("o_custkey"), "shards_a", "o_custkey", 4)
        return P.catalog_shards(spark, "shards_a").agg(F.count("*").alias("shards"), F.sum("n").alias("n"))

    @r.pair("compaction", "SELECT 1 AS files, count(*) AS n FROM orders")
    def _compaction(spark, sf):
        a, b = shared_folder(spark, "many"), shared_folder(spark, "few")
        table(spark, sf, "orders").repartition(9).write.parquet(a)
        files = C.compact(spark, a, b)
        return spark.read.parquet(b).agg(F.count("*").alias("n")).select(F.lit(files).alias("files"), "n")

    day = timedelta(days=1)

    @r.pair("time_partition_attach_detach", "SELECT count(*) AS n, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-02 00:00:00') AS first_day FROM events WHERE ts < TIMESTAMP '2024-01-02 00:00:00' OR ts >= TIMESTAMP '2024-01-03 00:00:00'")
    def _attach(spark, sf):
        """Two days leave the table, one comes back."""
        path, aside = shared_folder(spark, "parts"), shared_folder(spark, "aside")
        T.write_partitioned(table(spark, sf, "events").select("event_id", "ts"), path, "ts", day)
        T.detach_partition(spark, path, datetime(2024, 1, 1), f"{aside}/1")
        T.detach_partition(spark, path, datetime(2024, 1, 2), f"{aside}/2")
        T.attach_partition(spark, path, datetime(2024, 1, 1), f"{aside}/1")
        return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).alias("first_day"))

    @r.pair("time_partition_old_codec", "SELECT count(*) AS n, true AS rewritten FROM events")
    def _codec(spark, sf):
        path = shared_folder(spark, "parts")
        T.write_partitioned(table(spark, sf, "events").select("event_id", "ts"), path, "ts", day)
        n = T.set_old_partitions_codec(spark, path, day, datetime(2024, 1, 3), "gzip")
        return spark.read.parquet(path).agg(F.count("*").alias("n")).select("n", F.lit(n == 2).alias("rewritten"))

    @r.pair("intermediate_union", "SELECT k, count(*) AS n FROM (SELECT o_custkey % 5 AS k FROM orders UNION ALL SELECT c_custkey % 5 FROM customer) t GROUP BY k")
    def _union(spark, sf):
        """Several results read as one."""
        I.create_intermediate_result("u1", table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("k")))
        I.create_intermediate_result("u2", table(spark, sf, "customer").select((F.col("c_custkey") % 5).alias("k")))
        return I.read_intermediate_results(spark, ["u1", "u2"]).groupBy("k").agg(F.count("*").alias("n"))

    @r.pair("join_partition_wise", "SELECT CAST(a.ts AS DATE) AS d, count(*) AS n FROM events a JOIN events b ON CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.event_id = b.event_id WHERE a.ts < TIMESTAMP '2024-01-04 00:00:00' GROUP BY 1")
    def _partition_wise(spark, sf):
        """Two tables in the same time partitions, joined on partition and key: a filter on one side prunes the other's folders at run time."""
        a, b = shared_folder(spark, "pa"), shared_folder(spark, "pb")
        for p in (a, b):
            T.write_partitioned(table(spark, sf, "events").select("event_id", "ts"), p, "ts", day)
        x = T.read_range(spark, a, datetime(2024, 1, 1), datetime(2024, 1, 4))
        y = spark.read.parquet(b).select(T.PART, "event_id")
        return x.join(y, [T.PART, "event_id"]).groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))

    @r.pair("call_procedure", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey = 5 GROUP BY o_orderstatus")
    def _call(spark, sf):
        """A procedure is a function of the driver; its key's rows are found by a filter that reaches the scan."""

        def customer_report(key: int):
            return table(spark, sf, "orders").where(F.col("o_custkey") == key).groupBy("o_orderstatus").agg(F.count("*").alias("n"))

        return customer_report(5)
