"""Scans, sources and sinks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.operators.tables import save_table
from shardloom.sources import columnar as C
from shardloom.sources import intermediate as I
from shardloom.sources import timeparts as T
from shardloom.sources.copying import copy_from, copy_to
from shardloom.sources.intermediate import shared_folder


def register(r) -> None:
    r.sql("scan_columns", "SELECT l_suppkey, l_quantity FROM lineitem")
    r.sql("scan_count", "SELECT count(*) AS n FROM lineitem")
    r.sql("scan_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 4321")
    r.sql("values_list", "SELECT x, y FROM (VALUES (1, 'a'), (2, 'b')) t(x, y)")
    r.sql("series", "SELECT explode(sequence(1, 20, 3)) AS g", "SELECT CAST(unnest(generate_series(1, 20, 3)) AS INT) AS g")
    @r.pair("ctas", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
    def _ctas(spark, sf):
        """CREATE TABLE … AS SELECT, and a scan of the stored table."""
        save_table(table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")), "t_ctas")
        return spark.table("t_ctas")

    @r.pair("columnar_chunk_skipping", "SELECT true AS skipped, count(*) AS n FROM orders WHERE o_orderkey BETWEEN 100 AND 150")
    def _skipping(spark, sf):
        """Rows in key order in chunks of 1,000: the scan hands on one chunk of several."""
        path = shared_folder(spark, "columnar")
        C.write_columnar(table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartitionByRange("o_orderkey"), path, C.ColumnarOptions(stripe_rows=1000, chunk_rows=1000), order_by=["o_orderkey"])
        hits = C.read_columnar(spark, path).where("o_orderkey BETWEEN 100 AND 150")
        read, n = C.rows_read(hits)
        return spark.createDataFrame([(read <= 1000 < C.row_count(spark, path).first()[0], n)], "skipped boolean, n long")

    @r.pair("columnar_write_read", "SELECT l_suppkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_suppkey")
    def _columnar(spark, sf):
        """The whole table, written in key order; only two columns are read back."""
        path = shared_folder(spark, "columnar")
        C.write_columnar(table(spark, sf, "lineitem"), path, order_by=["l_orderkey"])
        return C.read_columnar(spark, path).groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))

    @r.pair("columnar_codecs", "SELECT codec, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, (VALUES ('none'), ('lz4'), ('zstd'), ('snappy'), ('gzip')) t(codec) GROUP BY codec")
    def _codecs(spark, sf):
        out = None
        for codec in C.CODECS:
            path = shared_folder(spark, codec)
            C.write_columnar(table(spark, sf, "orders"), path, C.ColumnarOptions(compression=codec))
            one = C.read_columnar(spark, path).select(F.lit(codec).alias("codec"), "o_totalprice")
            out = one if out is None else out.unionAll(one)
        return out.groupBy("codec").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    @r.pair("columnar_statistics", "SELECT \"column\", CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'o_orderkey' AS \"column\", count(*) AS n FROM orders UNION ALL SELECT 'o_totalprice', count(*) FROM orders) t GROUP BY \"column\"")
    def _statistics(spark, sf):
        path = shared_folder(spark, "columnar")
        C.write_columnar(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, C.ColumnarOptions(stripe_rows=5000))
        return C.chunk_statistics(spark, path).groupBy("column").agg(F.sum("rows").alias("n"))

    @r.pair("columnar_row_count", "SELECT count(*) AS n FROM lineitem")
    def _rows(spark, sf):
        """From the footers alone."""
        return C.row_count(spark, f"{sf}/lineitem.parquet")

    @r.pair("columnar_added_column", "SELECT extra, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 7 ELSE o_custkey END AS extra FROM orders) t GROUP BY extra")
    def _added(spark, sf):
        """Older files lack a column; its default stands in."""
        path, o = shared_folder(spark, "columnar"), table(spark, sf, "orders")
        C.write_columnar(o.where("o_orderstatus = 'F'").select("o_orderkey"), path)
        C.write_columnar(o.where("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_custkey").alias("extra")), path, mode="append")
        return C.read_columnar(spark, path, {"extra": 7}).groupBy("extra").agg(F.count("*").alias("n"))

    @r.pair("access_method", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
    def _method(spark, sf):
        """Columnar to ORC, and back."""
        a, b, c = (shared_folder(spark, x) for x in "abc")
        C.write_columnar(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), a)
        C.set_access_method(spark, a, b, "orc")
        C.set_access_method(spark, b, c, "columnar")
        return C.read_columnar(spark, c).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    @r.pair("intermediate_limit", "SELECT true AS refused, count(*) AS n FROM nation")
    def _limit(spark, sf):
        """A result over the limit is refused and leaves nothing; a smaller one is kept."""
        n = I.create_intermediate_result("small", table(spark, sf, "nation"), 1 << 20)
        try:
            I.create_intermediate_result("large", table(spark, sf, "orders"), 1000)
            refused = False
        except ValueError:
            refused = True
        return spark.createDataFrame([(refused, n)], "refused boolean, n long")

    @r.pair("copy_query", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey")
    def _copy_query(spark, sf):
        """COPY (query) TO, and back."""
        path = shared_folder(spark, "csv")
        rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
        copy_to(rows, path)
        return copy_from(spark, path, rows.schema)

    @r.pair("copy_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
    def _csv(spark, sf):
        path = shared_folder(spark, "csv")
        copy_to(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, header=True)
        return copy_from(spark, path, "c_custkey long, c_name string, c_acctbal double", header=True)

    @r.pair("copy_text", "SELECT id, v FROM (VALUES (1, 'a'), (2, NULL), (3, 'b,c')) t(id, v)")
    def _text(spark, sf):
        path = shared_folder(spark, "text")
        copy_to(spark.createDataFrame([(1, "a"), (2, None), (3, "b,c")], "id int, v string"), path, "text")
        return copy_from(spark, path, "id int, v string", "text")

    @r.pair("insert_values", "SELECT n_nationkey, n_name FROM nation UNION ALL VALUES (100, 'X'), (101, NULL)")
    def _insert(spark, sf):
        save_table(table(spark, sf, "nation").select("n_nationkey", "n_name"), "scan_nation")
        spark.sql("INSERT INTO scan_nation VALUES (100, 'X'), (101, NULL)")
        return spark.table("scan_nation")

    @r.pair("intermediate_result", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 18")
    def _intermediate(spark, sf):
        I.create_intermediate_result("scan", table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")))
        return I.broadcast_intermediate_result(spark, "scan").where("n > 18")

    @r.pair("intermediate_partitions", "SELECT CASE WHEN o_orderkey <= 3000 THEN 0 WHEN o_orderkey <= 9000 THEN 1 ELSE 2 END AS fragment, count(*) AS n FROM orders GROUP BY 1")
    def _partitions(spark, sf):
        return I.partition_query_result(table(spark, sf, "orders"), "o_orderkey", [3000, 9000], shared_folder(spark, "fragments"))

    @r.pair("tablesample_bounds", "SELECT true AS within")
    def _sample(spark, sf):
        table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
        n = spark.sql("SELECT count(*) AS n FROM lineitem TABLESAMPLE (20 PERCENT) REPEATABLE (11)")
        total = table(spark, sf, "lineitem").agg(F.count("*").alias("t"))
        return n.crossJoin(total).select((F.col("n") / F.col("t")).between(0.15, 0.25).alias("within"))

    @r.pair("cursor", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
    def _cursor(spark, sf):
        """FETCH 7 from a forward cursor."""
        rows = table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").toLocalIterator()
        return spark.createDataFrame([next(rows) for _ in range(7)], "o_orderkey long")

    @r.pair("empty_relation", "SELECT o_orderkey, x FROM orders LEFT JOIN (SELECT 1 AS k, 2 AS x WHERE false) e ON o_orderkey = k")
    def _empty(spark, sf):
        """A side whose shards are all pruned: no rows, the same columns."""
        none = spark.createDataFrame([], "k long, x int")
        return table(spark, sf, "orders").join(none, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", "x")

    day = timedelta(days=1)

    def parted(spark, sf):
        path = shared_folder(spark, "parts")
        T.write_partitioned(table(spark, sf, "events").select("event_id", "ts", "value"), path, "ts", day)
        return path

    @r.pair("time_partitions", "SELECT CAST(d AS TIMESTAMP) AS from_value, CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS to_value FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events) t")
    def _partitions_view(spark, sf):
        return T.time_partitions(spark, parted(spark, sf), day).select("from_value", "to_value")

    @r.pair("time_partitions_missing", "SELECT t AS from_value, t + INTERVAL 1 DAY AS to_value FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-25 00:00:00', TIMESTAMP '2024-01-03 00:00:00', INTERVAL 1 DAY)) AS t) s WHERE t NOT IN (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) FROM events)")
    def _missing(spark, sf):
        return T.missing_partition_ranges(spark, parted(spark, sf), day, datetime(2024, 1, 4), datetime(2023, 12, 25))

    @r.pair("time_partitions_create_drop", "SELECT count(*) AS n, true AS created, false AS again FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'")
    def _create_drop(spark, sf):
        path = parted(spark, sf)
        created = T.create_time_partitions(spark, path, day, datetime(2024, 1, 2), datetime(2023, 12, 28))
        again = T.create_time_partitions(spark, path, day, datetime(2024, 1, 2), datetime(2023, 12, 28))
        T.drop_old_time_partitions(spark, path, day, datetime(2024, 1, 5))
        return spark.read.parquet(path).agg(F.count("*").alias("n")).select("n", F.lit(created).alias("created"), F.lit(again).alias("again"))

    @r.pair("time_partition_pruning", "SELECT count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-04 00:00:00'")
    def _pruned(spark, sf):
        return T.read_range(spark, parted(spark, sf), datetime(2024, 1, 2), datetime(2024, 1, 4)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
