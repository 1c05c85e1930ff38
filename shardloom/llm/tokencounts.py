"""Token counts as delta-maintained rollups.

A rollup is a folder of commits. A commit holds the signed change of each (source, lang, tokenizer)
total and the new state of each (doc_id, tokenizer) that it touched. A batch of changes is turned
into signed rows: what a document counted before with a minus, what it counts now with a plus. Totals
are the sums of all commits' changes: no document is counted again. To learn what a batch's documents counted
before, it reads the states between its smallest and largest doc_id (a few narrow columns, no text), leaves out by
a semi join what it doesn't touch, and groups the rest. Of a
batch only the ids are read for that, so no text is counted twice.

compact() folds all commits into a base: one total a group, one state a (doc_id, tokenizer), sorted by
doc_id, so that files whose documents a batch doesn't touch are skipped by their statistics. From then on the base and later
commits are read. Commits stay, as they tell which batches are there. A base names the commits it holds and is
renamed to its place as a whole, so batches may be applied meanwhile; the largest base holds.

A commit is written aside and renamed to its batch's name as the last step, so that it is there as a
whole or not at all; a batch whose name is there already changes nothing, however often it is sent.
The rename fails if the name is there, so of two writers of one batch one succeeds. Two different batches
at the same time may each miss the other's states, so batches of one rollup must follow each other.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import fresh, n_words, need, shared_folder

KEY = ("doc_id", "tokenizer")
GROUP = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
STATE = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, commit int"


class TokenRollup:
    """Totals by source, language and tokenizer version, kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("commits", "bases"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def _path(self, where: str):
        return self._jvm.org.apache.hadoop.fs.Path(where)

    def commits(self) -> list[str]:
        """Names of the folders of all commits."""
        return self._names("commits")

    def _names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")))

    def _base(self) -> tuple[list[str], set[str]]:
        """The folder of the largest base, if there is one, and the commits it holds."""
        found = self._names("bases")
        if not found:
            return [], set()
        where = f"{self.root}/bases/{found[-1]}"
        return [where], {r.value for r in self.spark.read.text(f"{where}/names").collect()}  # as many as the list of commits has

    def _read(self, what: str, schema: str) -> DataFrame:
        base, held = self._base()
        return self._of([*base, *[f"{self.root}/commits/{n}" for n in self.commits() if n not in held]], what, schema)

    def _of(self, folders: list[str], what: str, schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{f}/{what}" for f in folders])

    def compact(self) -> bool:
        """Fold all commits into a new base; False if the base holds them already or another one came first."""
        base, held = self._base()
        names = self.commits()
        later = [n for n in names if n not in held]
        if not later:
            return False
        folders = [*base, *[f"{self.root}/commits/{n}" for n in later]]
        aside = f"{self.root}/aside-{uuid.uuid4().hex}"
        sums = self._of(folders, "deltas", DELTAS).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.parquet(f"{aside}/deltas")
        last = self._of(folders, "state", STATE).groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "n_tokens", "alive"), "commit").alias("s"), F.max("commit").alias("commit"))
        last.select(*KEY, "s.*", "commit").repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(f"{aside}/state")
        out = self._fs.create(self._path(f"{aside}/names"))
        out.write(bytearray("\n".join(names), "utf-8"))
        out.close()
        done = self._move(aside, f"{self.root}/bases/{len(names):010d}")
        if not done:
            self._fs.delete(self._path(aside), True)
        return done

    def _move(self, where: str, to: str) -> bool:
        """Rename a folder to a name that isn't there; False if it is."""
        jvm, conf = self._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = self._path(to)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
        try:
            files.rename(self._path(where), target, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        return True

    def state(self, touched: DataFrame | None = None) -> DataFrame:
        """The last state of each (doc_id, tokenizer) that ever was: source, lang, n_tokens, alive; of touched ones only, if given."""
        rows = self._read("state", STATE)
        if touched is not None:
            ends = touched.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
            rows = rows.where(F.col("doc_id").between(ends.lo, ends.hi)).join(touched.select(*KEY), list(KEY), "left_semi")
        last = rows.groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "n_tokens", "alive"), "commit").alias("s"))
        return last.select(*KEY, "s.*")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups without documents are left out."""
        sums = self._read("deltas", DELTAS).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes (doc_id, tokenizer, action, source, lang, n_tokens, seq); False if it is there already.

        action: insert counts a document, in place of what it counted before; revise does so only for
        documents that count now; delete takes a document out, if it is in. Anything else raises when
        the batch is computed. Of several changes of one (doc_id, tokenizer) the one with the largest seq holds, of equal
        ones the largest by its values. Null n_tokens count as 0, null sources and languages are
        groups of their own, rows without doc_id are left out. Other columns are left out. A batch may
        have any name that doesn't begin with . or _. Texts aren't kept, so their length doesn't matter here.
        """
        need(changes, *KEY, "action", "source", "lang", "n_tokens", "seq")
        name = quote(batch, safe="-_.")
        if not batch or name.startswith((".", "_")):
            raise ValueError("a batch needs a name that doesn't begin with . or _")
        if name in self.commits():
            return False
        number = len(self.commits())
        change = F.struct("seq", "action", "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        known = F.col("action").isin("insert", "revise", "delete")
        checked = changes.where("doc_id is not null").withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null"))))))
        new = checked.groupBy(*KEY).agg(F.max(change).alias("c"))
        before = self.state(changes.where("doc_id is not null"))
        both = new.join(before.select(*KEY, F.struct("source", "lang", "n_tokens", "alive").alias("b")), list(KEY), "left") if number else new.withColumn("b", F.lit(None).cast("struct<source:string,lang:string,n_tokens:bigint,alive:boolean>"))
        was = F.coalesce(F.col("b.alive"), F.lit(False))
        now = (F.col("c.action") == "insert") | ((F.col("c.action") == "revise") & was)
        both = both.withColumn("was", was).withColumn("now", now).where("was or now")

        aside = f"{self.root}/aside-{uuid.uuid4().hex}"
        rows = both.select(*KEY, F.col("c.source").alias("source"), F.col("c.lang").alias("lang"), F.col("c.n_tokens").alias("n_tokens"), F.col("now").alias("alive"), F.lit(number).alias("commit"), "b", "was")
        rows.write.parquet(f"{aside}/state")
        told = self.spark.read.parquet(f"{aside}/state")

        def signed(sign: int, which: str, at: str) -> DataFrame:
            return told.where(which).select(F.col(f"{at}source").alias("source"), F.col(f"{at}lang").alias("lang"), "tokenizer", F.lit(sign).alias("d"), (sign * F.col(f"{at}n_tokens")).alias("t"))

        moved = signed(-1, "was", "b.").unionAll(signed(1, "alive", ""))
        moved.groupBy(*GROUP).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens")).write.parquet(f"{aside}/deltas")
        done = self._move(aside, f"{self.root}/commits/{name}")
        if not done:
            self._fs.delete(self._path(aside), True)
        return done


def changes(docs: DataFrame, action: str, counts: dict[str, Column], seq: int = 0) -> DataFrame:
    """Changes of documents (doc_id, source, lang): one for each tokenizer version and its count.

    Versions are listed first and counted by a CASE after that, so whoever needs the ids alone reads no text.
    """
    need(docs, "doc_id", "source", "lang")
    version = fresh(docs, "tokenizer")[0]
    count = F.lit(None).cast("long")
    for k, v in counts.items():
        count = F.when(F.col(version) == k, v.cast("long")).otherwise(count)
    each = docs.withColumn(version, F.explode(F.array(*map(F.lit, counts))))
    return each.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(version).alias("tokenizer"), F.lit(action).alias("action"), "source", "lang", count.alias("n_tokens"), F.lit(seq).alias("seq"))


def versions(text: Column) -> dict[str, Column]:
    """Two counts of a text by tokenizer version: words, and bytes by four, rounded up."""
    return {"words-1": n_words(text), "bytes4-1": F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)}


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents inserted; those labelled toxic deleted; those of low quality recounted without repeated lines; commits folded between; a batch sent twice."""
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.apply("1-insert", changes(docs, "insert", versions(F.col("text"))))
    # Counts are taken before the join and an inner join stays above them, so no text is shuffled
    told = labels.groupBy(F.col("doc_id").alias("k")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    labelled = lambda rows, which: rows.join(told.where(which), F.col("doc_id") == F.col("k"))
    toxic = labelled(changes(docs, "delete", {k: F.lit(0) for k in versions(F.lit(""))}), "toxic = 1")
    rollup.apply("2-takedown", toxic)
    rollup.compact()
    once = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    rollup.apply("3-recount", labelled(changes(docs, "revise", versions(once)), "quality = 0"))
    rollup.apply("2-takedown", toxic)
    return rollup.totals()


ORACLE = """
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
    SELECT documents.doc_id, source, lang,
           CASE WHEN l.quality = 0 THEN array_to_string(list_distinct(string_split(text, chr(10))), chr(10)) ELSE coalesce(text, '') END AS t
    FROM documents LEFT JOIN l ON documents.doc_id = l.doc_id WHERE l.toxic IS DISTINCT FROM 1
), c AS (
    SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM d
    UNION ALL
    SELECT source, lang, 'bytes4-1', (coalesce(strlen(t), 0) + 3) // 4 FROM d
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY source, lang, tokenizer
"""
