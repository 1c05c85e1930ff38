"""The pipeline's stages on small tables, and its registered queries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shardloom.llm import queries
from tests.compare import SF, duck, rows as plain_rows
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, secrets, texts without letters and nulls."""
    r = random.Random(8)
    parts = {"aa": ["tion", "the", "ing", "and", "re"], "bb": ["ung", "sch", "der", "keit", "ein"]}
    made = lambda lang, n: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    out = []
    for i in range(150):
        lang = r.choice(["aa", "bb"])
        out.append((i, made(lang, r.randrange(20, 200)), lang, r.choice(["s0", "s0", "s1", None])))
    out += [(200 + i, out[0][1], out[0][2], "s0") for i in range(30)]
    out += [(300 + i, out[1][1] + f" more{i}", out[1][2], "s1") for i in range(20)]
    out += [(400, made("aa", 60) + " token=abcdef123456", "aa", "s1"), (401, "12 34", "aa", "s0"), (402, None, "bb", "s0"), (403, "", "bb", None)]
    where = f"file://{tmp_path_factory.mktemp('docs')}"
    table = spark.createDataFrame([(*x, len(x[1] or "")) for x in out], SCHEMA)
    table.write.parquet(f"{where}/documents.parquet")
    return where, {x[0]: x for x in out}


def test_stages_in_turn(spark, folder):
    where, by = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "mix", "tokens"]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["language"](spark, docs, where).persist()
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(by) - {401, 402, 403}

    one = stage["near_duplicates"](spark, kept, where).persist()
    want = brute.jaccard_components([(x.doc_id, x.text) for x in kept.collect()])
    assert one.columns == docs.columns and {x.doc_id for x in one.collect()} == {i for i, (_, low) in want.items() if low == i}

    clean = stage["secrets"](spark, one, where).persist()
    texts = {x.doc_id: x for x in clean.collect()}
    assert clean.columns == docs.columns and set(texts) == {x.doc_id for x in one.collect()}
    assert texts[400].text.endswith(" [SECRET]") and texts[400].n_chars == len(texts[400].text)
    assert all(texts[i].text == by[i][1] for i in texts if i != 400)

    mixed = stage["mix"](spark, clean, where).persist()
    assert mixed.columns == docs.columns
    size = Counter()
    for x in texts.values():
        size[x.source] += len(brute.words(x.text))
    taken = Counter()
    for x in mixed.collect():
        taken[x.source] += len(brute.words(x.text))
    for s, goal in brute.targets(size).items():
        assert abs(taken[s] - goal) <= max(len(brute.words(x.text)) for x in texts.values() if x.source == s) + 1

    last = stage["tokens"](spark, mixed, where)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = {i: hashlib.sha256(x.text.encode()).hexdigest() for i, x in texts.items()}
    assert Counter(x.doc_id for x in mixed.collect()) == Counter(x.doc_id for x in last.collect())
    assert all(x.decoded_sha256 == sha[x.doc_id] for x in last.collect())


def test_run_and_empty_table(spark, folder, tmp_path):
    where, _ = folder
    assert corpus_pipeline.run(spark, where).count() > 50
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_clashing_columns(spark, folder):
    where, _ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name in ("found", "mix", "id", "component", "size", "rid", "key", "one", "repeat"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), where).columns == docs.columns, name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_oracles(spark, name):
    got = queries.queries()[name](spark, SF)
    want = duck().execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain_rows(got.columns, [tuple(x) for x in got.collect()]) == plain_rows(columns, want.fetchall())


def test_every_operator_has_its_query():
    assert [sum(n.startswith(f"op{k}_") for n in queries.queries()) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in queries.queries()
