"""The registered queries over the smallest tables, against plain versions."""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from shardloom.llm import langid, queries
from tests.compare import SF
from tests.llm import brute
from tests.llm.test_media_operators import plain_links

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def documents(spark):
    return [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, name):
    return queries.queries()[name](spark, SF).collect()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2_agrees_with_a_search_of_all_sets(spark, documents):
    """Forward selection against the penalised likelihood of every set of languages."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(spark, table.where(~langid.held_out(table.doc_id)))
    found = {x.doc_id: x for x in result(spark, "op2_mixture_langid")}
    assert len(found) == len(documents)
    same = tried = 0
    for i, text in documents[:60]:
        if found[i].lang_pred == langid.UNKNOWN:
            assert not text or not any(c.isalpha() for c in text)
            continue
        counts = langid.trigram_counts(text)
        seen = np.flatnonzero(counts)
        c, p = counts[seen].astype(float), model.likelihood[seen]
        price = langid.PENALTY * 0.5 * np.log(c.sum() + 1)
        every = []
        for n in range(1, len(model.languages) + 1):
            for some in itertools.combinations(range(len(model.languages)), n):
                share, value = langid.em(c, p[:, some], np.full(n, 1 / n))
                every.append((value - n * price, some, share))
        _, some, share = max(every, key=lambda e: e[0])
        tried += 1
        same += found[i].lang_pred == model.languages[some[int(np.argmax(share))]]
    assert tried > 30 and same >= 0.97 * tried


def test_op4_has_the_components_of_all_pairs(spark, documents):
    want = brute.jaccard_components(documents)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in result(spark, "op4_ngram_jaccard")} == want


def test_op5_has_the_links_of_all_pairs(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "vec_id").collect()]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in result(spark, "op5_ego_join")}
    assert got == plain_links(rows)


def test_op6_gives_payloads_and_revisits(spark):
    pages = [(x.page_id, (x.html or "").encode()) for x in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    first: dict[bytes, int] = {}
    for i, raw in sorted(pages):
        first.setdefault(raw, i)
    want = {(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first[raw] == i else "revisit", None if first[raw] == i else first[raw]) for i, raw in pages}
    assert {tuple(x[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for x in result(spark, "op6_warc")} == want


def test_op7_gives_back_the_payloads(spark, documents):
    by = {x.doc_id: x for x in result(spark, "op7_avi")}
    assert len(by) == len(documents)
    for i, text in documents:
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        x = by[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    forms = Counter((x.payload_sha256, x.media_sha256, x.feature) for x in by.values())
    assert len(forms) == len({x.payload_sha256 for x in by.values()})


def test_op9_has_the_base_spans(spark, documents):
    by = {x.doc_id: x for x in result(spark, "op9_secret_scan")}
    for i, text in documents:
        spans = brute.base_spans(text)
        n = Counter(k for k, _, _ in spans)
        assert (by[i].n_assign, by[i].n_access, by[i].n_hex) == (n["assign"], n["access"], n["hex"])
        assert by[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def test_op10_agrees_with_the_library(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    by = {x.doc_id: x for x in result(spark, "op10_bpe")}
    for i, text in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (by[i].n_tokens, by[i].ids_sha256, by[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
