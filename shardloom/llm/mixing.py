"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: the sources share RATIO times all words by weight; a target stops at CAP times its source's
words, and what is above is shared again among the others by weight (water-filling, found in closed
form over the table of sources).

Sampling: every document of a source is expected target / words times in the mix. The expected
copies are summed in order of size within the source, one random offset per source is added, and a
document is emitted once for each whole number that its interval of the running sum crosses. As
neighbours have nearly equal sizes, the words taken differ from the target by no more than the
source's largest document, and no document is taken more than ceil(CAP) times.

The running sum needs no task that holds a source: rows are range-partitioned by source, size and a
hash, so that a hot source spreads over many partitions. monotonically_increasing_id() numbers the
rows of each partition in order, a small table holds the count of each (partition, source), and its
running sum gives every row its rank. The numbered rows are written to the shared folder, since ids
that are computed twice need not agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import fresh, n_words, need, shared_table

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (3, 1, 2)
RATIO = 1.5
CAP = 2.0
SEED = "mix-1"
#: The numbers of a partition's rows, below the partition's index.
ROW_BITS = 33


def _weight(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((i - 1) % len(WEIGHTS) + 1).cast("int"))


def targets(sizes: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """source, source_size long, target double: one row for each source of rows (source, size).

    The windows run over one row per source, after a grouped sum; sources are names, not data.
    Sources without words get 0. Without any row, there is no row.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = per.withColumn("w", _weight(F.row_number().over(in_order))).withColumn("cap", F.lit(CAP) * F.col("source_size"))
    # Sources are filled up in order of cap / weight. If the k first are at their cap, the others get
    # (total - caps) / weights per weight; the level is the first that leaves the next source below its cap.
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    w = w.withColumn("total", F.lit(RATIO) * F.sum("source_size").over(everything))
    w = w.withColumn("rest", F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    w = w.withColumn("full", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    w = w.withColumn("open", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("full"), F.col("level")))).over(everything))
    return w.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("open.level") * F.col("w"), F.col("cap"))).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source: a multiple of 2^-20 in [0, 1), so that sums with whole numbers are exact."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0null")))), 1, 5), 16, 10).cast("double") / float(1 << 20)


def sample(docs: DataFrame, seed: str = SEED, words: Column | None = None) -> DataFrame:
    """docs with a struct column mix: size, source_size, target, copies (how often the document is in the mix).

    words: the size of a document; by default the number of words of text, which needs that column.
    All other columns stay, whatever their names; if one is called mix, the new one is called _mix.
    Null and empty texts have size 0; a source without words has target 0 and its documents 0 copies.
    Ties of size are ordered by a hash of doc_id, so a rerun gives equal results; rows that repeat
    one doc_id are interchangeable. An empty table stays empty.
    """
    need(docs, "doc_id", "source", *(["text"] if words is None else []))
    doc_id, source = "doc_id", "source"
    size, tie, rid, pid, first, before, mix, part, name = fresh(docs, "size", "tie", "rid", "pid", "first", "before", "mix", "part", "name")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col(source).isNull(), F.col(source), F.col(size), F.col(tie), F.col(doc_id)]
    sized = docs.withColumn(size, n_words(F.col("text")) if words is None else words).withColumn(tie, F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    # the last key spreads rows that repeat one doc_id
    ranged = sized.repartitionByRange(parts, *key, F.rand(7)).sortWithinPartitions(*key)
    rows = shared_table(ranged.withColumn(rid, F.monotonically_increasing_id()), "mix").drop(tie)
    rows = rows.withColumn(pid, F.shiftright(rid, ROW_BITS))

    runs = rows.groupBy(pid, F.col(source).alias("s")).agg(F.min(rid).alias(first), F.count("*").alias("n"), F.sum(size).alias("words"))
    # runs has a row for each partition and source: it grows with the number of partitions, not with the rows
    earlier = Window.partitionBy("s").orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    goal = targets(runs, "s", "words").withColumnRenamed("source", "g").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    runs = runs.join(goal, F.col("s").eqNullSafe(F.col("g"))).select(
        F.col(pid).alias(part), F.col("s").alias(name), F.struct(F.col(before).alias("before"), F.col(first).alias("first"), "source_size", "target", "rate").alias(before)
    )
    rows = rows.join(runs, (F.col(pid) == F.col(part)) & F.col(source).eqNullSafe(F.col(name)))
    r = F.col(before)
    rank = r.getField("before") + F.col(rid) - r.getField("first")
    u, rate = offset(F.col(source), seed), r.getField("rate")
    crossed = F.floor(u + (rank + 1) * rate) - F.floor(u + rank * rate)
    copies = F.least(crossed, F.ceil(rate))
    out = F.struct(F.col(size).alias("size"), r.getField("source_size").alias("source_size"), r.getField("target").alias("target"), copies.cast("long").alias("copies"))
    return rows.select(*[c for c in docs.columns], out.alias(mix))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as sample() takes it, with the columns of docs."""
    out = sample(docs, seed)
    mix = out.columns[-1]
    repeat = fresh(out, "repeat")[0]
    return out.where(F.col(f"{mix}.copies") > 0).withColumn(repeat, F.explode(F.array_repeat(F.lit(True), F.col(f"{mix}.copies").cast("int")))).drop(mix, repeat)


ORACLE = """
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), per AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS BIGINT)) AS w
    FROM d GROUP BY source
), filled AS (
    SELECT *, 2.0::DOUBLE * source_size AS cap,
           (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM per WINDOW up AS (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, encode(source))
), goal AS (
    SELECT source, source_size,
           least(cap, coalesce(first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * w, cap)) AS target
    FROM filled
), ranked AS (
    SELECT d.*, goal.source_size, goal.target, CASE WHEN goal.source_size > 0 THEN goal.target / goal.source_size ELSE 0 END AS rate,
           row_number() OVER (PARTITION BY d.source ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank,
           CAST('0x' || substr(md5('mix-1:' || coalesce(d.source, chr(0) || 'null')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS u
    FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(u + (rank + 1) * rate) - floor(u + rank * rate), ceil(rate)) AS BIGINT) * size AS taken
FROM ranked
"""
