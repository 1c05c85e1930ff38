"""Frames with gaps, rows by number, foreign tables, captured changes, statistics of statements."""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardloom.catalog import register_views, table
from shardloom.operators import modify as M
from shardloom.operators import statistics as O
from shardloom.operators.rewrites import aggregate_excluding, groups_frame
from shardloom.sources import columnar as C
from shardloom.sources import copying as Y
from shardloom.sources import foreign as X
from shardloom.sources import intermediate as I
from shardloom.sources import timeparts as T
from shardloom.sources.intermediate import shared_folder
from shardloom.streaming import changes as S

AGGREGATES = ("sum", "count", "min", "max", "avg")


def _over(frame: str) -> str:
    each = ", ".join(f"round({a}(o_totalprice) OVER w, 6) AS {a}_" for a in AGGREGATES)
    return f"SELECT o_orderkey, {each} FROM orders WINDOW w AS (PARTITION BY o_custkey {frame})"


def register(r) -> None:
    def excluded(df, before, after, own=False):
        return df.select("o_orderkey", *[F.round(aggregate_excluding(a, F.col("o_totalprice"), before, after, own), 6).alias(f"{a}_") for a in AGGREGATES])

    @r.pair("win_exclude_current", _over("ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW"))
    def _current(spark, sf):
        w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
        return excluded(table(spark, sf, "orders"), w.rowsBetween(-2, -1), w.rowsBetween(1, 1))

    def grouped(spark, sf, own):
        df, _ = groups_frame(Window.partitionBy("o_custkey"), [F.col("o_orderpriority")], table(spark, sf, "orders"), 1, 1, ["o_custkey"])
        w = Window.partitionBy("o_custkey").orderBy("_group")
        return excluded(df, w.rangeBetween(-1, -1), w.rangeBetween(1, 1), own)

    @r.pair("win_exclude_group", _over("ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP"))
    def _group(spark, sf):
        return grouped(spark, sf, False)

    @r.pair("win_exclude_ties", _over("ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES"))
    def _ties(spark, sf):
        return grouped(spark, sf, True)

    @r.pair("columnar_rows_at", "SELECT n AS row_number, o_orderkey, o_custkey FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n, o_orderkey, o_custkey FROM orders) t WHERE n IN (0, 7, 500, 1499)")
    def _rows_at(spark, sf):
        """Rows by number from files in key order; a number beyond the end gives none."""
        path = shared_folder(spark, "columnar")
        C.write_columnar(table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartitionByRange(4, "o_orderkey"), path, order_by=["o_orderkey"])
        return C.rows_at(spark, path, [0, 7, 500, 1499, 1 << 40])

    @r.pair("foreign_scan", "SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM nation WHERE n_regionkey > 1 GROUP BY n_regionkey")
    def _foreign(spark, sf):
        """A table of another database, read in three tasks; the filter is sent there."""
        url = X.packed_database(table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name"), "foreign_nation")
        far = X.foreign_table(spark, url, "foreign_nation", ("n_nationkey", 0, 25, 3)).where("n_regionkey > 1")
        if "n_regionkey" not in O.explain(far).partition("PushedFilters")[2]:
            raise RuntimeError("the filter wasn't sent")
        return far.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("n_name").alias("last"))

    @r.pair("copy_stdin", "SELECT id, v FROM (VALUES (1, 'a'), (2, NULL), (3, 'b,c')) t(id, v)")
    def _stdin(spark, sf):
        """Lines up to the end mark."""
        return Y.copy_from_lines(spark, ["1,a", "2,", '3,"b,c"', "\\.", "4,x"], "id int, v string")

    @r.pair("copy_program", "SELECT id, v FROM (VALUES (1, 'a'), (2, NULL)) t(id, v)")
    def _program(spark, sf):
        return Y.copy_from_program(spark, ["printf", r"1\ta\n2\t\\N\n"], "id int, v string", "text")

    @r.pair("cdc_capture", "SELECT op, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 'update' AS op, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'delete', o_totalprice FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT 'insert', o_totalprice FROM orders WHERE o_orderkey % 10 = 2) t GROUP BY op")
    def _capture(spark, sf):
        """A table's changes from its state before and after three statements."""
        old, tens = table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey") % 10
        new = M.delete(M.update(old, tens == 0, {"o_totalprice": F.col("o_totalprice") + 1}), tens == 1)
        new = M.insert(new, old.where(tens == 2).select((-F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice"))
        path = shared_folder(spark, "state")
        new.write.parquet(path)
        return S.changes_between(old, spark.read.parquet(path), "o_orderkey").groupBy("op").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    @r.pair("intermediate_pruning", "SELECT true AS pruned, count(*) AS n FROM orders WHERE o_orderkey BETWEEN 200 AND 800")
    def _pruning(spark, sf):
        """Of a result in fragments, those are read that a range of keys can need."""
        path, bounds = shared_folder(spark, "fragments"), [100, 900]
        I.partition_query_result(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", bounds, path)
        near = I.read_fragments(spark, path, bounds, 200, 800)
        read, kept = C.rows_read(near)
        return near.where("o_orderkey BETWEEN 200 AND 800").agg((F.lit(read) == near.where("o_orderkey BETWEEN 101 AND 900").count()).alias("pruned"), F.count("*").alias("n"))

    @r.pair("time_partition_range", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS from_value, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS to_value FROM events GROUP BY 1, 2")
    def _range(spark, sf):
        """From each folder's name to its range."""
        path, day = shared_folder(spark, "parts"), timedelta(days=1)
        T.write_partitioned(table(spark, sf, "events").select("event_id", "ts"), path, "ts", day)
        names = [p.partition for p in T.time_partitions(spark, path, day).collect()]
        return spark.createDataFrame([T.time_partition_range(n, day) for n in names], "from_value timestamp_ntz, to_value timestamp_ntz")

    @r.pair("volatility", "SELECT * FROM (VALUES ('rand()', true), ('uuid()', true), ('n_nationkey + 1', false), ('upper(n_name)', false), ('current_date()', false)) t(expression, volatile)")
    def _volatility(spark, sf):
        nation = table(spark, sf, "nation")
        return spark.createDataFrame([(e, O.is_volatile(nation, e)) for e in ("rand()", "uuid()", "n_nationkey + 1", "upper(n_name)", "current_date()")], "expression string, volatile boolean")

    @r.pair("statement_statistics", "SELECT 'SELECT count(*) AS n FROM orders WHERE o_orderkey < $1' AS statement, CAST(2 AS BIGINT) AS calls, CAST(2 AS BIGINT) AS rows UNION ALL SELECT 'SELECT n_name FROM nation WHERE n_name > $1', 1, count(*) FROM nation WHERE n_name > 'F'")
    def _statements(spark, sf):
        """Statements that differ in literals alone count as one; a reset forgets what came before it."""
        register_views(spark, sf, ["orders", "nation"])
        seen = O.StatementStatistics(spark)
        seen.run("SELECT 1 AS x")
        seen.reset()
        for text in ("SELECT count(*) AS n FROM orders WHERE o_orderkey < 10", "SELECT count(*) AS n FROM orders  WHERE o_orderkey < 500", "SELECT n_name FROM nation WHERE n_name > 'F'"):
            seen.run(text)
        return seen.view().select("statement", "calls", "rows")

    @r.pair("explain_forms", "SELECT true AS filters, count(*) AS n FROM orders WHERE o_totalprice > 100000")
    def _forms(spark, sf):
        """The plan as JSON names the filter; analyzed, it tells the rows that passed it."""
        df = table(spark, sf, "orders").where("o_totalprice > 100000").select("o_orderkey")
        named = any(n["class"].endswith(".Filter") for n in json.loads(O.explain(df, "json")))
        passed = [int(line.rpartition("rows=")[2]) for line in O.explain(df, "analyze").splitlines() if line.strip().startswith("Filter")]
        return spark.createDataFrame([(named, passed[0])], "filters boolean, n long")
