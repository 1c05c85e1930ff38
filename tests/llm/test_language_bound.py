"""Texts shared about evenly by three languages are clean."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.llm import langid


def test_a_third_is_enough(spark, monkeypatch):
    monkeypatch.setattr(langid, "fit", lambda *_: None)
    monkeypatch.setattr(langid, "identify", lambda _spark, _model, text: F.struct(F.lit("en").alias("lang_pred"), text.cast("double").alias("score")))
    rows = [(1, "0.3333333333"), (2, "0.336"), (3, "0.34"), (4, "0.26")]
    out = langid.keep_identified(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in out.collect()} == {1, 2, 3}
