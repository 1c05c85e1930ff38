"""Near links of documents whose set came first with a row that can't pass its signatures on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shardloom.llm import jaccard

A = " ".join(f"w{i}" for i in range(80))
NEAR_A = A + " more"
B = " ".join(f"v{i}" for i in range(20))


def components(spark, rows, parts=1):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(parts)
    return {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs).where(F.col("doc_id").isNotNull()).collect()}


def test_set_first_seen_without_id(spark):
    assert components(spark, [(None, A), (5, A), (7, NEAR_A)]) == {5: 5, 7: 5}


@pytest.mark.parametrize("sent", [jaccard.MOST_SENT, 0])
def test_set_first_seen_under_an_id_placed_elsewhere(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "MOST_SENT", sent)
    assert components(spark, [(5, A), (5, B), (9, A), (4, A), (7, NEAR_A), (6, B + " more")]) == {5: 5, 6: 5, 9: 4, 4: 4, 7: 4}


def test_set_that_no_document_is_placed_by(spark):
    assert components(spark, [(5, A), (5, B), (7, NEAR_A)]) == {5: 5, 7: 7}
