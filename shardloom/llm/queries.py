"""The queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import avi, bpe, chat, egojoin, jaccard, langid, mixing, secrets, tokencounts, warc
from shardloom.llm.common import arrow_limits, n_words


def tokenizer_path() -> str:
    """The vocabulary file of op10; any byte-level BPE file of the tokenizers library will do."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe_digest(spark, _table(spark, sf_dir, "documents"))


def bpe_digest(spark: SparkSession, docs: DataFrame, mb: int = 4) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents; a worker gets about mb of text at a time."""
    arrow_limits(spark, mb=mb)
    coded = bpe.round_trip(spark, docs, tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a rollup after inserts, deletes, recounts and a repeated batch."""
    return tokencounts.query(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, with the inferred mixture."""
    arrow_limits(spark)
    found = langid.predict(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join("languages", ",").alias("mixture"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    sizes = _table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n"))
    out = mixing.sample(sizes, words=F.col("n"))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document: five words, Jaccard of at least 80 %."""
    arrow_limits(spark)
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and component of every embedding: cosine of at least 0.9, all labels together."""
    arrow_limits(spark)
    return egojoin.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    arrow_limits(spark)
    back = warc.read(warc.write(_table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a motion-JPEG AVI and read back, with its clips as feature."""
    arrow_limits(spark, rows=256, mb=4)
    back = avi.read(avi.store(_table(spark, sf_dir, "documents")))
    clip = F.transform("clips", lambda c: F.format_string("%.2f-%.2f:%d:%.3f", c["start_s"], c["end_s"], c["frames"], c["mean_luma"]))
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.array_join(clip, ";").alias("feature"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back."""
    return chat.digest(chat.with_probe(_table(spark, sf_dir, "conversations")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "entropy")],
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixture_langid": op2_mixture_langid,
    "op3_mix_sources": op3_mix_sources,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_ego_join": op5_ego_join,
    "op6_warc": op6_warc,
    "op7_avi": op7_avi,
    "op8_chat_format": op8_chat_format,
    "op9_secret_scan": op9_secret_scan,
    "op10_bpe": op10_bpe,
}
ORACLES: dict[str, str] = {"op1_token_counts": tokencounts.ORACLE, "op3_mix_sources": mixing.ORACLE, "op8_chat_format": chat.ORACLE}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
