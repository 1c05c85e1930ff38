"""Multilingual mixture inference.

A language is a distribution over byte trigrams of lower-cased text, hashed into BUCKETS classes
and smoothed. A text is a mixture of languages: expectation-maximisation finds the proportions that
make its trigrams likeliest. The set of languages grows one at a time, each time by the language
that adds most, as long as the likelihood gains more than the penalty for another proportion
(half the logarithm of the text's length in trigrams, times PENALTY).

A candidate needs no EM run if it can't pay: the log-likelihood is concave in the proportions, so
what language j adds is at most n * (mean over trigrams of p_j / p_mixture - 1).

Model: counts over all labelled training texts, summed by Spark; its size is BUCKETS x languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import fresh, only
from shardloom.session import ship

BUCKETS = 1 << 14
SMOOTHING = 0.5
PENALTY = 3.0
EM_STEPS = 60
EM_STOP = 1e-4
#: A model of more languages isn't broadcast; it raises ValueError. 1,000 take 130 MB.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
RESULT = "lang_pred string, score double, languages array<string>, proportions array<double>"


def trigram_counts(text: str) -> np.ndarray:
    """How often each class of trigrams occurs in the whole text, white space included, framed by spaces."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)  # a multiplicative hash: its high bits are even
    return np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)


@dataclass(frozen=True)
class MixtureModel:
    """likelihood[i, j]: the probability of class i in language j."""

    languages: tuple[str, ...]
    likelihood: np.ndarray

    @classmethod
    def of_counts(cls, languages: tuple[str, ...], counts: np.ndarray) -> MixtureModel:
        smooth = counts.astype(float) + SMOOTHING
        return cls(languages, smooth / smooth.sum(axis=0, keepdims=True))

    def infer(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """Language of the largest proportion, that proportion, and the set with its proportions, largest first."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, [], []
        counts = trigram_counts(text)
        seen = np.flatnonzero(counts)
        c, p = counts[seen].astype(float), self.likelihood[seen]
        n = c.sum()
        logs = c @ np.log(p)
        chosen = [int(np.argmax(logs))]
        share, best = np.ones(1), float(logs[chosen[0]])
        price = PENALTY * 0.5 * np.log(n + 1)
        while len(chosen) < len(self.languages):
            mixture = p[:, chosen] @ share
            gain = (c / mixture) @ p - n
            gain[chosen] = -np.inf
            options = [j for j in np.argsort(-gain) if gain[j] > price]
            found = None
            for j in options:
                if gain[j] <= (found[0] - best if found else price):
                    break
                now, value = em(c, p[:, [*chosen, j]], np.append(share * 0.9, 0.1))
                if value - best > price and (found is None or value > found[0]):
                    found = value, j, now
            if found is None:
                break
            best, share = found[0], found[2]
            chosen.append(int(found[1]))
        order = sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))
        return self.languages[chosen[order[0]]], float(min(1.0, share[order[0]])), [self.languages[chosen[k]] for k in order], [float(share[k]) for k in order]


def em(c: np.ndarray, p: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that maximise the likelihood of counts c under components p, and that log-likelihood."""
    n = c.sum()
    for _ in range(EM_STEPS):
        new = share * ((c / (p @ share)) @ p) / n  # expected counts of each component, as shares
        done = np.abs(new - share).max() < EM_STOP
        share = new
        if done:
            break
    return share, float(c @ np.log(p @ share))


def fit(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang") -> MixtureModel:
    """Learn from all rows with text and language. Each partition sends its summed counts of a class and language once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("langid", dict)  # what an earlier operator kept in this worker goes
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in total:
                    total[name] = np.zeros(BUCKETS, np.int64)
                total[name] += trigram_counts(t)
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    ship(spark)
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = sums.toPandas()  # at most BUCKETS x languages rows
    languages = tuple(sorted(model["lang"].unique()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES}")
    counts = np.zeros((BUCKETS, len(languages)))
    counts[model["bucket"].to_numpy(), pd.Categorical(model["lang"], categories=languages).codes] = model["n"]
    return MixtureModel.of_counts(languages, counts)


def identify(spark: SparkSession, model: MixtureModel, text: Column) -> Column:
    """struct<lang_pred, score, languages, proportions> of each whole text.

    und and 0 for null texts, texts without a letter, and every text if the model has no language.
    Equal texts get equal results.
    """
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only("langid", dict)
        m = sent.value
        for texts in batches:
            yield pd.DataFrame([m.infer(t) for t in texts], columns=["lang_pred", "score", "languages", "proportions"])

    return infer(text)


def held_out(doc_id: Column) -> Column:
    """True for the third of documents that nothing is learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def predict(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, proportions; learned from the documents that aren't held out.

    One row for each row, repeated ones too; equal texts get equal predictions. Null texts, empty texts
    and texts without a letter are und with score 0. Of equally likely languages the first by name is
    taken. Rows without text or lang teach nothing. Other columns are left out; an empty table gives an
    empty result.
    """
    model = fit(spark, docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(spark, model, F.col("text")).alias("r"))
    return found.select("doc_id", "held_out", "r.*")


def keep_identified(spark: SparkSession, docs: DataFrame, min_score: float = 0.33) -> DataFrame:
    """The documents with a language: not und, and a largest proportion of at least min_score. All columns stay as they are.

    The model is learned as in predict. A text in two or three languages is clean and stays; only one
    that no language holds a third of goes; the bound is a little below a third, so that even thirds stay.
    """
    model = fit(spark, docs.where(~held_out(F.col("doc_id"))))
    r = fresh(docs, "found")[0]
    return docs.withColumn(r, identify(spark, model, F.col("text"))).where((F.col(f"{r}.lang_pred") != UNKNOWN) & (F.col(f"{r}.score") >= min_score)).drop(r)
