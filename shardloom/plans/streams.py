"""Change streams, rollups and event-time windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.catalog import table
from shardloom.operators import modify as M
from shardloom.sources.intermediate import shared_folder
from shardloom.streaming import changes as S


def register(r) -> None:
    r.sql("rollup_minute", "SELECT date_trunc('minute', ts) AS m, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY date_trunc('minute', ts), event_type")
    r.sql("rollup_hour_users", "SELECT date_trunc('hour', ts) AS h, count(DISTINCT user_id) AS users FROM events GROUP BY date_trunc('hour', ts)")

    def change_log(spark, sf):
        """Changes of a user's last value: every event is one, errors delete the user."""
        e = table(spark, sf, "events")
        op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
        return e.select(op.alias("op"), F.col("event_id").alias("seq"), "user_id", "value")

    state = "SELECT user_id, value FROM (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) t WHERE k = 1 AND event_type <> 'error'"

    @r.pair("cdc_apply", state)
    def _apply(spark, sf):
        return S.apply_changes(spark.createDataFrame([], "user_id long, value double"), change_log(spark, sf), "user_id")

    @r.pair("cdc_apply_batches", state)
    def _batches(spark, sf):
        """The same, as a stream of micro-batches that each write a new state; a batch that comes twice changes nothing."""
        root = shared_folder(spark, "cdc")
        change_log(spark, sf).repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(f"{root}/log")
        schema = spark.read.parquet(f"{root}/log").schema

        def each(batch, number: int) -> None:
            before = spark.read.parquet(f"{root}/state/{number - 1}") if number else spark.createDataFrame([], "user_id long, value double, seq long")
            last = S.latest(batch.unionByName(before.select(F.lit("update").alias("op"), "seq", "user_id", "value")), "user_id")
            # deletes stay as rows without value: a change that is older than a delete may come in a later batch
            last.select("user_id", F.when(F.col("op") != "delete", F.col("value")).alias("value"), "seq").write.mode("overwrite").parquet(f"{root}/state/{number}")

        S.run_batches(S.read_stream(spark, f"{root}/log", schema, 1), each, f"{root}/checkpoint")
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{root}/state")
        n = max(int(f.getPath().getName()) for f in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where))
        return spark.read.parquet(f"{root}/state/{n}").where("value IS NOT NULL").select("user_id", "value")

    @r.pair("cdc_publish", "SELECT 'events' AS \"table\", count(*) AS n FROM events WHERE event_id % 5 <> 0")
    def _publish(spark, sf):
        """Shards' changes under the table's name, without those of a shard move."""
        log = change_log(spark, sf).withColumn("shard", F.concat(F.lit("events_"), F.col("user_id") % 3)).withColumn("moved", F.col("seq") % 5 == 0)
        return S.publish(log, {f"events_{i}": "events" for i in range(3)}).groupBy("table").agg(F.count("*").alias("n"))

    @r.pair("cdc_schema_change", "SELECT event_id AS user_id, CAST(NULL AS DOUBLE) AS value FROM events")
    def _schema(spark, sf):
        """The log lacks a column that the table has, and has one that it lacks."""
        log = table(spark, sf, "events").select(F.lit("insert").alias("op"), F.col("event_id").alias("seq"), F.col("event_id").alias("user_id"), F.lit(1).alias("gone"))
        return S.apply_changes(spark.createDataFrame([], "user_id long, value double"), log, "user_id")

    @r.pair("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
    def _tumbling(spark, sf):
        e, root = table(spark, sf, "events"), shared_folder(spark, "events")
        e.write.parquet(root)  # a stream reads folders
        stream = S.read_stream(spark, root, e.schema).withColumn("ts", F.col("ts").cast("timestamp"))
        out = S.run_to_files(S.tumbling(stream, "ts", "1 hour", "10 minutes", "event_type"), shared_folder(spark, "tumbling"), "complete")
        return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))

    @r.pair("window_sliding", "SELECT w AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) t GROUP BY w")
    def _sliding(spark, sf):
        return table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")

    @r.pair("stream_session", "SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTES, true) AS gap FROM events) a) b GROUP BY user_id, s) c GROUP BY user_id, n")
    def _session(spark, sf):
        e, root = table(spark, sf, "events"), shared_folder(spark, "events")
        e.write.parquet(root)
        stream = S.read_stream(spark, root, e.schema, 1000).withColumn("ts", F.col("ts").cast("timestamp"))
        out = S.run_to_files(S.sessions(stream, "ts", "30 minutes", "10 minutes", "user_id"), shared_folder(spark, "sessions"), "complete")
        return out.groupBy("user_id", "n").agg(F.count("*").alias("sessions"))

    @r.pair("stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
    def _dedup(spark, sf):
        """Every event is sent twice."""
        e = table(spark, sf, "events")
        root = shared_folder(spark, "twice")
        e.write.parquet(f"{root}/e")
        e.write.mode("append").parquet(f"{root}/e")
        stream = S.read_stream(spark, f"{root}/e", e.schema, 1000).withColumn("ts", F.col("ts").cast("timestamp"))
        out = S.run_to_files(S.deduplicated(stream, "ts", "1 hour", "event_id"), shared_folder(spark, "dedup"), "append")
        return out.agg(F.count("*").alias("n"))

    @r.pair("clock_order", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS INT) AS n FROM events")
    def _clock(spark, sf):
        """Causal order of each user's changes: epoch milliseconds, then a counter."""
        e = table(spark, sf, "events").select("user_id", "event_id", S.clock(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id")).alias("seq"))
        return S.in_order(e, "user_id").select("user_id", "event_id", "n")

    @r.pair("rollup_incremental", "SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2")
    def _incremental(spark, sf):
        """INSERT … SELECT … ON CONFLICT DO UPDATE: a rollup that takes two batches."""
        e = table(spark, sf, "events").withColumn("h", F.date_trunc("hour", "ts"))
        part = lambda which: e.where(which).groupBy(F.struct("h", "event_type").alias("key")).agg(F.count("*").alias("n"))
        both = M.upsert(part("event_id < 4000"), part("event_id >= 4000"), "key", {"n": F.col("n") + F.col("excluded.n")})
        return both.select("key.h", "key.event_type", "n")
