"""Data modification: the state of a copy of a table after each statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.operators import modify as M
from shardloom.operators.tables import distribute, save_table
from shardloom.sources.intermediate import shared_folder


def _statements(r) -> None:
    """The statements on orders; the new rows of upserts and merges are all orders under keys larger by 1500."""
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    orders = lambda spark, sf: table(spark, sf, "orders").select(*cols)
    base = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)"

    @r.pair("dml_update", f"SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey < 100 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM {base} t")
    def _update(spark, sf):
        return M.update(orders(spark, sf), F.col("o_custkey") < 100, {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})

    @r.pair("dml_update_returning", f"SELECT o_orderkey, o_custkey, 'Y' AS o_orderstatus, o_totalprice FROM {base} t WHERE o_totalprice > 400000")
    def _returning(spark, sf):
        return M.updated_rows(orders(spark, sf), F.col("o_totalprice") > 400000, {"o_orderstatus": F.lit("Y")})

    @r.pair("dml_delete", f"SELECT * FROM {base} t WHERE NOT (o_orderstatus = 'F')")
    def _delete(spark, sf):
        return M.delete(orders(spark, sf), F.col("o_orderstatus") == "F")

    @r.pair("dml_delete_using", f"SELECT * FROM {base} t WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
    def _using(spark, sf):
        return M.delete_using(orders(spark, sf), table(spark, sf, "customer").where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"))

    @r.pair("dml_update_from", f"SELECT o_orderkey, o_custkey, coalesce(substring(c_mktsegment, 1, 3), o_orderstatus) AS o_orderstatus, o_totalprice FROM {base} t LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey = 5")
    def _from(spark, sf):
        c = table(spark, sf, "customer").where("c_nationkey = 5").select("c_custkey", "c_mktsegment")
        return M.update_from(orders(spark, sf), c, "o_custkey", "c_custkey", {"o_orderstatus": F.substring("excluded.c_mktsegment", 1, 3)})

    @r.pair("dml_insert_select", f"SELECT * FROM {base} t UNION ALL SELECT o_orderkey + 1000000, o_custkey, NULL, NULL FROM {base} u WHERE o_custkey < 50")
    def _insert(spark, sf):
        o = orders(spark, sf)
        return M.insert(o, o.where("o_custkey < 50").select((F.col("o_orderkey") + 1000000).alias("o_orderkey"), "o_custkey"))

    new = "(SELECT o_orderkey + 1500 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice FROM orders)"

    def rows(spark, sf):
        o = table(spark, sf, "orders")
        return o.select((F.col("o_orderkey") + 1500).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), "o_totalprice")

    @r.pair("dml_upsert", f"SELECT coalesce(t.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(t.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN t.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL THEN t.o_orderstatus || n.o_orderstatus ELSE coalesce(t.o_orderstatus, n.o_orderstatus) END AS o_orderstatus, coalesce(t.o_totalprice, n.o_totalprice) AS o_totalprice FROM {base} t FULL JOIN {new} n ON t.o_orderkey = n.o_orderkey")
    def _upsert(spark, sf):
        return M.upsert(orders(spark, sf), rows(spark, sf), "o_orderkey", {"o_orderstatus": F.concat("o_orderstatus", "excluded.o_orderstatus")})

    @r.pair("dml_insert_ignore", f"SELECT * FROM {base} t UNION ALL SELECT * FROM {new} n WHERE n.o_orderkey NOT IN (SELECT o_orderkey FROM {base} b)")
    def _ignore(spark, sf):
        return M.upsert(orders(spark, sf), rows(spark, sf), "o_orderkey")

    @r.pair("dml_merge", f"SELECT coalesce(t.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, t.o_custkey) AS o_custkey, CASE WHEN t.o_orderkey IS NULL THEN 'new' ELSE t.o_orderstatus END AS o_orderstatus, CASE WHEN t.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE coalesce(t.o_totalprice, 0) END AS o_totalprice FROM {base} t FULL JOIN {new} n ON t.o_orderkey = n.o_orderkey WHERE NOT (t.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL AND t.o_orderstatus = 'P')")
    def _merge(spark, sf):
        x = lambda c: F.col(f"excluded.{c}")
        clauses = [
            M.When("matched", F.col("o_orderstatus") == "P", "delete"),
            M.When("matched", None, "update", {"o_totalprice": x("o_totalprice"), "o_custkey": x("o_custkey")}),
            M.When("not matched", None, "insert", {"o_orderkey": x("o_orderkey"), "o_custkey": x("o_custkey"), "o_orderstatus": F.lit("new"), "o_totalprice": F.lit(0.0)}),
        ]
        return M.merge(orders(spark, sf), rows(spark, sf), "o_orderkey", "o_orderkey", clauses)

    @r.pair("dml_merge_not_matched_by_source", f"SELECT t.o_orderkey, t.o_custkey, CASE WHEN n.o_orderkey IS NULL THEN 'gone' ELSE t.o_orderstatus END AS o_orderstatus, t.o_totalprice FROM {base} t LEFT JOIN {new} n ON t.o_orderkey = n.o_orderkey WHERE NOT (n.o_orderkey IS NULL AND t.o_totalprice < 100000)")
    def _by_source(spark, sf):
        clauses = [M.When("not matched by source", F.col("o_totalprice") < 100000, "delete"), M.When("not matched by source", None, "update", {"o_orderstatus": F.lit("gone")})]
        return M.merge(orders(spark, sf), rows(spark, sf), "o_orderkey", "o_orderkey", clauses)

    @r.pair("dml_merge_actions", f"SELECT action, count(*) AS n FROM (SELECT CASE WHEN t.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'keep' ELSE 'update' END AS action FROM {base} t FULL JOIN {new} n ON t.o_orderkey = n.o_orderkey) x GROUP BY action")
    def _actions(spark, sf):
        x = lambda c: F.col(f"excluded.{c}")
        clauses = [M.When("matched", None, "update", {"o_totalprice": x("o_totalprice")}), M.When("not matched", None, "insert", {c: x(c) for c in cols})]
        return M.merge(orders(spark, sf), rows(spark, sf), "o_orderkey", "o_orderkey", clauses, delta=True).groupBy(F.col("_action").alias("action")).agg(F.count("*").alias("n"))

    @r.pair("dml_truncate", f"SELECT * FROM {base} t WHERE false")
    def _truncate(spark, sf):
        return M.truncate(orders(spark, sf))

    @r.pair("dml_store_current", f"SELECT o_orderstatus, count(*) AS n FROM {base} t WHERE o_orderstatus <> 'O' GROUP BY o_orderstatus")
    def _store(spark, sf):
        """Two states are stored; the name leads to the second."""
        root = shared_folder(spark, "orders")
        M.store(orders(spark, sf), root)
        M.store(M.delete(M.current(spark, root), F.col("o_orderstatus") == "O"), root)
        return M.current(spark, root).groupBy("o_orderstatus").agg(F.count("*").alias("n"))

    @r.pair("dml_modifying_cte", f"SELECT o_orderstatus, count(*) FILTER (WHERE o_custkey < 300) AS gone, count(*) FILTER (WHERE o_custkey >= 300) AS stayed FROM {base} t GROUP BY o_orderstatus")
    def _cte(spark, sf):
        """WITH d AS (DELETE … RETURNING *) SELECT …: the rows that go, and what the stored state holds then."""
        o, root, which = orders(spark, sf), shared_folder(spark, "orders"), F.col("o_custkey") < 300
        M.store(M.delete(o, which), root)
        rows = M.deleted_rows(o, which).select("o_orderstatus", F.lit(True).alias("d")).unionAll(M.current(spark, root).select("o_orderstatus", F.lit(False)))
        return rows.groupBy("o_orderstatus").agg(F.count_if("d").alias("gone"), F.count_if(~F.col("d")).alias("stayed"))


def register(r) -> None:
    _statements(r)

    @r.pair("dml_insert_repartition", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey < 0")
    def _insert_repartition(spark, sf):
        """Rows move to the target's key on their way in."""
        from shardloom.operators.tables import distribute, distributed

        distribute(table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")), "dml_counts", "k", 8)
        return distributed(spark, "dml_counts")

    @r.pair("dml_insert_values", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(k, v)")
    def _values(spark, sf):
        """Two INSERTs into a stored table, of one row and of several."""
        save_table(spark.createDataFrame([], "k int, v string"), "dml_values")
        spark.sql("INSERT INTO dml_values VALUES (1, 'a')")
        spark.sql("INSERT INTO dml_values (k, v) VALUES (2, 'b'), (3, NULL)")
        return spark.table("dml_values")

    cols = ["o_orderkey", "o_custkey", "o_totalprice"]

    @r.pair("dml_merge_colocated", "SELECT t.o_orderkey, t.o_custkey, t.o_totalprice + CASE WHEN t.o_custkey % 2 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders t")
    def _merge_colocated(spark, sf):
        """Both tables lie in buckets of the key: no row moves."""
        o = table(spark, sf, "orders").select(*cols)
        distribute(o, "merge_target", "o_orderkey", 8)
        distribute(o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("k")), "merge_source", "k", 0, colocate_with="merge_target")
        clauses = [M.When("matched", None, "update", {"o_totalprice": F.col("o_totalprice") + 1})]
        return M.merge(spark.table("merge_target"), spark.table("merge_source"), "o_orderkey", "k", clauses, keyed=True)

    @r.pair("dml_delete_returning", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
    def _delete_returning(spark, sf):
        gone = M.deleted_rows(table(spark, sf, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))
        return gone.select(*cols)

    @r.pair("dml_insert_returning", "SELECT o_orderkey + 1000000 AS o_orderkey, o_custkey, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders WHERE o_custkey < 50")
    def _insert_returning(spark, sf):
        o = table(spark, sf, "orders").select(*cols)
        return M.inserted_rows(o, o.where("o_custkey < 50").select((F.col("o_orderkey") + 1000000).alias("o_orderkey"), "o_custkey"))

    @r.pair("dml_merge_returning", "SELECT coalesce(t.o_orderkey, n.k) AS o_orderkey, coalesce(t.o_custkey, n.c) AS o_custkey, CASE WHEN t.o_orderkey IS NULL THEN 0 WHEN t.o_totalprice > 300000 THEN t.o_totalprice ELSE t.o_totalprice + 1 END AS o_totalprice, CASE WHEN t.o_orderkey IS NULL THEN 'insert' WHEN t.o_totalprice > 300000 THEN 'delete' ELSE 'update' END AS action FROM (SELECT o_orderkey + 100 AS k, o_custkey AS c FROM orders) n LEFT JOIN orders t ON t.o_orderkey = n.k")
    def _merge_returning(spark, sf):
        o = table(spark, sf, "orders").select(*cols)
        rows = o.select((F.col("o_orderkey") + 100).alias("k"), F.col("o_custkey").alias("c"))
        clauses = [
            M.When("matched", F.col("o_totalprice") > 300000, "delete"),
            M.When("matched", None, "update", {"o_totalprice": F.col("o_totalprice") + 1}),
            M.When("not matched", None, "insert", {"o_orderkey": F.col("excluded.k"), "o_custkey": F.col("excluded.c"), "o_totalprice": F.lit(0.0)}),
        ]
        return M.merge_returning(o, rows, "o_orderkey", "k", clauses).withColumnRenamed("_action", "action")
