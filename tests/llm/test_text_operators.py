"""Token counts, language, mixing, near duplicates, secrets, BPE: against plain versions, and at the edges."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import bpe, jaccard, langid, mixing, secrets, tokencounts
from shardloom.llm.queries import tokenizer_path
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\x0c\r ", None, None),
    (4, "one", "en", "b"),
    (5, "x" * 5000 + " " + "word " * 3000, "en", "b"),
    (6, "Äöü ß 日本語 🙂   \x85 end", "de", None),
    (7, "same text here for all of them", "en", "a"),
    (7, "same text here for all of them", "en", "a"),
    (8, "same text here for all of them", "en", "c"),
    (None, "no id at all", "en", "a"),
]


# --- token counts


def test_rollup_is_signed_idempotent_and_additive(spark, tmp_path):
    r = tokencounts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    cols = "doc_id long, tokenizer string, action string, source string, lang string, n_tokens long, seq int"
    first = spark.createDataFrame([(1, "t", "insert", "a", "en", 5, 0), (2, "t", "insert", "a", None, 7, 0), (3, "t", "insert", "b", "en", None, 0), (3, "t", "insert", "b", "en", 4, 1), (9, "t", "delete", "b", "en", 4, 1), (None, "t", "insert", "b", "en", 4, 1)], cols)
    assert r.apply("one", first) and not r.apply("one", first)
    total = lambda: {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert total() == {("a", "en"): (1, 5), ("a", None): (1, 7), ("b", "en"): (1, 4)}
    second = spark.createDataFrame([(1, "t", "revise", "c", "en", 6, 0), (2, "t", "delete", "x", "x", 0, 0), (8, "t", "revise", "a", "en", 9, 0)], cols)
    assert r.apply("two", second)
    assert total() == {("c", "en"): (1, 6), ("b", "en"): (1, 4)}
    again = tokencounts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert not again.apply("two", second) and len(again.commits()) == 2
    assert again.apply("three", spark.createDataFrame([(2, "t", "revise", "a", "en", 1, 0), (2, "u", "insert", "a", "en", 3, 0)], cols))
    assert total()[("a", "en")] == (1, 3)
    assert again.apply("empty", second.limit(0))
    with pytest.raises(Exception, match="unknown action"):
        again.apply("bad", spark.createDataFrame([(1, "t", "drop", "a", "en", 1, 0)], cols))
    assert len(again.commits()) == 4
    with pytest.raises(ValueError):
        again.apply("_x", second)


def test_folded_commits_change_no_total(spark, tmp_path):
    cols = "doc_id long, tokenizer string, action string, source string, lang string, n_tokens long, seq int"
    rng = random.Random(8)
    plain, folded = (tokencounts.TokenRollup(spark, f"file://{tmp_path}/{n}") for n in ("plain", "folded"))
    assert not folded.compact()
    told = lambda r: sorted(map(tuple, r.totals().collect()), key=repr)
    states = lambda r: sorted(map(tuple, r.state().collect()), key=repr)
    for k in range(6):
        rows = [(rng.randrange(30), rng.choice("tu"), rng.choice(["insert", "revise", "delete"]), rng.choice(["a", None]), "en", rng.randrange(9), i) for i in range(20)]
        batch = spark.createDataFrame(rows, cols)
        assert plain.apply(f"{k}/x", batch) and folded.apply(f"{k}/x", batch)
        if k in (1, 3, 4):
            assert folded.compact() and not folded.compact()
        assert not folded.apply(f"{k}/x", batch)
        assert told(folded) == told(plain) and states(folded) == states(plain)
    late = tokencounts.TokenRollup(spark, folded.root)
    assert len(late.commits()) == 6 and len(late._base()[1]) == 5 and told(late) == told(plain)
    # what is read: the base and the one commit after it
    assert {f.split("/folded/")[1].split("/state/")[0] for f in late._read("state", tokencounts.STATE).inputFiles()} == {"bases/0000000005", "commits/5%252Fx"}


def test_ids_of_changes_are_read_without_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("tokenizer", F.lit("own"))
    found = tokencounts.changes(docs, "insert", tokencounts.versions(F.col("text")))
    assert found.groupBy("tokenizer").count().count() == 2 and found.where("n_tokens is null").isEmpty()
    plan = found.select(*tokencounts.KEY)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "doc_id" in plan


def test_a_fold_beside_a_writer_loses_nothing(spark, tmp_path):
    row = lambda i, n: spark.createDataFrame([(i, "t", "insert", "s", "l", n, 0)], "doc_id long, tokenizer string, action string, source string, lang string, n_tokens long, seq int")
    r, other = (tokencounts.TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    assert r.apply("a", row(1, 5)) and r.apply("b", row(2, 7))
    other.commits = lambda: ["a"]  # it looked before b was there
    assert other.compact() and not other.compact()
    assert r.apply("c", row(2, 1)) and [tuple(x) for x in r.totals().collect()] == [("s", "l", "t", 2, 6)]


# --- language


def made(language: str, n: int, r: random.Random) -> str:
    parts = {"aa": ["tion", "the", "ing", "and", "re"], "bb": ["ung", "sch", "der", "keit", "ein"], "cc": ["eau", "oux", "ment", "les", "que"]}[language]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_language_accuracy_and_mixtures(spark):
    r = random.Random(5)
    rows = [(i, made(lang := r.choice(["aa", "bb", "cc"]), r.randrange(5, 60), r), lang, "s") for i in range(400)]
    rows += [(1000, made("aa", 150, r) + " " + made("bb", 60, r), None, None), (1001, "12 34 !?", "aa", "s"), (1002, None, "aa", "s"), (1003, "", "aa", "s"), (None, made("cc", 30, r), None, None)]
    out = {x.doc_id: x for x in langid.predict(spark, docs(spark, rows)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out == (i in held) for i in range(400))
    assert np.mean([out[i].lang_pred == rows[i][2] for i in held]) >= 0.95
    assert out[1000].lang_pred == "aa" and set(out[1000].languages) == {"aa", "bb"} and 0.55 < out[1000].score < 0.85
    for i in (1001, 1002, 1003):
        assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
    assert out[None].lang_pred == "cc"
    assert all(0 <= x.score <= 1 for x in out.values())


def test_em_finds_the_likeliest_proportions():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(50), 2).T
    c = rng.multinomial(4000, 0.3 * p[:, 0] + 0.7 * p[:, 1]).astype(float)
    share, value = langid.em(c, p, np.array([0.5, 0.5]))
    grid = [(float(c @ np.log(p @ np.array([a, 1 - a]))), a) for a in np.linspace(0.001, 0.999, 999)]
    assert abs(share[0] - max(grid)[1]) < 0.01 and value >= max(grid)[0] - 0.05


def test_language_without_training_rows(spark):
    out = langid.predict(spark, docs(spark, [(1, "some text", None, None)])).collect()
    assert (out[0].lang_pred, out[0].score) == ("und", 0.0)
    assert langid.predict(spark, docs(spark, [])).count() == 0


def test_keep_identified_keeps_columns_and_clean_rows(spark):
    r = random.Random(2)
    rows = [(i, made(lang := r.choice(["aa", "bb"]), 40, r), lang, "s") for i in range(60)] + [(99, "...", "aa", "s"), (98, None, "aa", "s")]
    t = docs(spark, rows).withColumn("found", F.lit("clash")).withColumn("score", F.lit(1))
    out = langid.keep_identified(spark, t)
    assert out.columns == t.columns and {x.doc_id for x in out.collect()} == set(range(60))


# --- mixing


def mixed_rows(seed: int):
    r = random.Random(seed)
    rows = [(i, "w " * r.choice([0, 1, 3, 10, 200]), "en", r.choice(["s1", "s2", "S3", "ä", None, "hot", "hot", "hot"])) for i in range(600)]
    return rows + [(5, "w w w", "en", "hot")] * 40


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_reaches_targets(spark, seed):
    rows = mixed_rows(seed)
    out = mixing.sample(docs(spark, rows)).select("doc_id", "source", "mix.*").collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(brute.words(t))
    want = brute.targets(size)
    taken, largest = Counter(), Counter()
    for x in out:
        assert x.source_size == size[x.source] and x.target == pytest.approx(want[x.source])
        assert 0 <= x.copies <= 2
        taken[x.source] += x.copies * x.size
        largest[x.source] = max(largest[x.source], x.size)
    assert len(out) == len(rows)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] + 1
    again = mixing.sample(docs(spark, rows[::-1])).select("doc_id", "source", "mix.*").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_mix_is_the_sum_of_whole_numbers_crossed(spark):
    """Copies by hand: running sums in order of size, then of a hash."""
    rows = mixed_rows(3)[:600]
    out = {x.doc_id: x for x in mixing.sample(docs(spark, rows)).select("doc_id", "source", "mix.*").collect()}
    for s in {x[3] for x in rows}:
        own = sorted((len(brute.words(t)), hashlib.md5(str(i).encode()).hexdigest(), i) for i, t, _, k in rows if k == s)
        rate = out[own[0][2]].target / out[own[0][2]].source_size
        u = int(hashlib.md5(f"mix-1:{s if s is not None else chr(0) + 'null'}".encode()).hexdigest()[:5], 16) / (1 << 20)
        for k, (_, _, i) in enumerate(own):
            assert out[i].copies == int(u + (k + 1) * rate) - int(u + k * rate)


def test_mix_at_the_edges(spark):
    t = docs(spark, EDGE).withColumn("mix", F.lit("clash")).withColumn("size", F.lit(-1)).withColumn("RID", F.lit(0))
    out = mixing.sample(t)
    assert out.columns == [*t.columns, "_mix"] and out.count() == len(EDGE)
    m = mixing.mixed(t)
    assert m.columns == t.columns
    assert mixing.sample(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0
    assert mixing.sample(docs(spark, [(1, None, None, None)])).first()["mix"].copies == 0


# --- near duplicates


def near_rows(seed: int) -> list:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], []
    for i in range(60):
        base.append([r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 5, 6, 9, 20, 60, 150, 400]))])
        rows.append(" ".join(base[-1]))
    for _ in range(240):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            k = r.randrange(len(w) + 1)
            w[k : k + r.choice([0, 1])] = [r.choice(vocabulary)] if r.random() < 0.7 else []
        rows.append((" " if r.random() < 0.5 else "\n").join(x.upper() if r.random() < 0.1 else x for x in w))
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows += [passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 120))) for _ in range(40)]
    template = [r.choice(vocabulary) for _ in range(200)]
    for _ in range(60):
        w = list(template)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(200)] = r.choice(vocabulary)
        rows.append(" ".join(w))
    rows += [None, "", " \t", "ſ K", "Kelvin k", "a b", "A b", "To To To To To of of of of of to to", "x " * 3000]
    order = list(range(1, len(rows) + 1))
    r.shuffle(order)
    return [(i, t, None, None) for i, t in zip(order, rows)]


def test_near_duplicates_lose_no_link(spark):
    rows = near_rows(1)
    want = brute.jaccard_components([(i, t) for i, t, _, _ in rows])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(docs(spark, rows)).collect()}
    assert got == want
    kept = {x.doc_id for x in jaccard.keep_one(docs(spark, rows)).collect()}
    assert kept == {i for i, (_, low) in want.items() if i == low}


@pytest.mark.parametrize("t", [80, 90, 60])
def test_signatures_are_shared_by_all_similar_sets(t):
    """Pairs at and just below the most that may differ, of all sizes: each has a common signature."""
    rng = np.random.default_rng(t)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for n in [*range(1, 40), 63, 64, 65, 100, 127, 128, 129, 255, 256, 500, 1023, 1024, 3000]:
        for _ in range(20):
            a = np.unique(draw(n))
            cut = rng.integers(0, n - -(-t * n // 100) + 1)
            grow = 0
            while 100 * (n - cut) >= t * (n + grow + 1):
                grow += 1
            grow = rng.integers(0, grow + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[cut:], draw(grow)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= t * (len(a) + len(b) - both) and both < max(len(a), len(b)):  # equal sets are one class and need none
                assert np.intersect1d(jaccard.signatures(a, t), jaccard.signatures(b, t)).size, (n, cut, grow)


def test_sets_whose_elements_meet_in_one_partition_share_signatures():
    """Equal high bits put all elements in one second-level partition; another hash, or at last one signature for all of them, must do."""
    rng = np.random.default_rng(3)
    for n in (8, 40, 300):
        a = np.unique(rng.integers(0, 1 << 31, n, dtype=np.uint64) | np.uint64(5 << 40))
        b = np.unique(np.concatenate([a[1:], rng.integers(0, 1 << 31, 1, dtype=np.uint64) | np.uint64(5 << 40)]))
        assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size
        assert len(np.unique(jaccard.signatures(a))) > 1


def test_subsets_leave_second_level_partitions_out():
    """A difference of one element in a set of one first-level partition leaves a common signature, though no projection on the whole partition is common."""
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 63, 6, dtype=np.uint64))
    b = np.sort(np.append(a[1:], np.uint64(12345678901234567)))
    size, band = np.array([6]), np.array([2])
    one, of, failed = jaccard._enumerated(a, size, band, np.array([1]), 12, 0, 8.0)
    two, _, _ = jaccard._enumerated(b, size, band, np.array([1]), 12, 0, 8.0)
    assert not failed[0] and len(one) > 1 and set(of) == {0}
    assert np.intersect1d(one, two).size


def test_shingles_of_many_texts_equal_those_of_each():
    texts = [None, "", "a", "a b c d", "a b c d e", "A b C d e f", "x " * 40, " ", "one two three four five six seven"]
    flat, ends = jaccard.shingle_sets(texts)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [jaccard.shingles(t).tolist() for t in texts]
    assert np.diff(ends).tolist() == [0, 0, 1, 1, 1, 2, 1, 0, 3]


def test_large_classes_find_their_least_id(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 5)
    monkeypatch.setattr(jaccard, "HOT_PARTS", 10)
    many = " ".join(f"h{i}" for i in range(30))
    rows = [(100 + i, many, None, None) for i in range(20)] + [(i, f"pair {i // 2} a b c d e f", None, None) for i in range(20)] + [(50, many + " z", None, None)]
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs(spark, rows)).collect()}
    assert got == {**{100 + i: 50 for i in range(20)}, **{i: i - i % 2 for i in range(20)}, 50: 50}


def test_near_duplicates_at_the_edges(spark):
    t = docs(spark, EDGE).withColumn("component", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("Key", F.lit(0)).withColumn("one", F.lit(0))
    got = sorted(map(tuple, jaccard.near_duplicates(t).collect()), key=repr)
    assert len(got) == len(EDGE)
    by = {i: (n, c) for i, n, c in got}
    assert by[1] == by[2][:1] + (1,) == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3)
    assert by[8] == (3, 7) and by[7] == (3, 7) and by[None] == (1, None)
    kept = jaccard.keep_one(t)
    assert kept.columns == t.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 7, None])
    assert jaccard.keep_one(docs(spark, [])).count() == 0


def test_batches_with_odd_names_and_two_writers(spark, tmp_path):
    row = lambda i, n: spark.createDataFrame([(i, "t", "insert", "s", "l", n, 0)], "doc_id long, tokenizer string, action string, source string, lang string, n_tokens long, seq int")
    one, two = (tokencounts.TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    assert one.apply("day 1/a", row(1, 5)) and one.apply("[*] {x}", row(2, 7))
    assert not two.apply("day 1/a", row(1, 9))
    assert [tuple(x) for x in two.totals().collect()] == [("s", "l", "t", 2, 12)]
    # a writer that looked before the other had committed
    two.commits = lambda: one.commits()[:-1]
    assert not two.apply("day 1/a", row(1, 9)) or not two.apply("[*] {x}", row(2, 8))
    assert [tuple(x) for x in one.totals().collect()] == [("s", "l", "t", 2, 12)]


def test_mixing_keeps_columns_of_any_name(spark):
    t = docs(spark, [(1, "a b", "x", "s"), (2, "c", "x", None)])
    for name in ("_p", "_s", "part", "name", "before", "rid", "mix", "g", "n", "s", "words"):
        t = t.withColumn(name, F.lit(name))
    out = mixing.sample(t)
    assert out.columns[:-1] == t.columns and out.columns[-1] == "_mix" and out.count() == 2
    assert mixing.mixed(t).columns == t.columns


# --- secrets


def secret_texts(seed: int) -> list:
    r = random.Random(seed)
    letters = "abcdefABCDEF0123456789+/_=-ghiXYZ"
    pieces = ["password", "PassWd ", "token", "API_KEY", "apikey", "secret", ": ", "=", ' = "', "'", '":', "AKIA", "AKIAKIA", "\n", " ", "é", "🙂", "ſecret=abcdefgh", "toKen: abcdefgh", "password: token: abcdefgh", "sha256-", "EXAMPLE", "00000000000000000000000000", "a" * 30 + "1"]

    def run():
        k = r.randrange(4)
        if k == 0:
            return "".join(r.choice("0123456789abcdef") for _ in range(r.randrange(1, 45)))
        if k == 1:
            return "".join(r.choice(letters) for _ in range(r.randrange(1, 60)))
        if k == 2:
            return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randrange(1, 25)))
        return r.choice(pieces)

    return ["".join(r.choice([run(), r.choice(pieces)]) for _ in range(r.randrange(1, 25))) for _ in range(300)] + [None, "", "x" * 20000 + " token=abcdef123", "550e8400-e29b-41d4-a716-446655440000"]


def test_secrets_match_plain_scans(spark):
    texts = secret_texts(4)
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    out = {x.doc_id: x.t for x in secrets.scan(docs(spark, rows)).select("doc_id", secrets.span_text(F.col("spans")).alias("t")).collect()}
    kinds = {k: i for i, k in enumerate(secrets.KINDS)}
    for i, t in enumerate(texts):
        hot = brute.entropy_spans(t, secrets.WINDOW, secrets.HEX_BITS, secrets.MIXED_BITS, secrets.ALLOW)
        found = [(a, kinds[k], b) for k, a, b in brute.base_spans(t)] + [(a, 3, b) for a, b in hot]
        assert out[i] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)), t


def test_redaction(spark):
    t = spark.createDataFrame([(1, "a token=abcdef123 b", 19, "x"), (2, "clean", 5, "x"), (3, None, None, "x"), (4, "é 🙂 " + "0123456789abcdef" * 2 + "!", 37, "x")], "doc_id long, text string, n_chars long, found string")
    out = {x.doc_id: x for x in secrets.redact(t).collect()}
    assert secrets.redact(t).columns == t.columns
    assert (out[1].text, out[1].n_chars) == ("a [SECRET] b", 12)
    assert (out[2].text, out[3].text, out[4].text) == ("clean", None, "é 🙂 [SECRET]!")
    assert secrets.redact(t.limit(0)).count() == 0 and secrets.scan(t.limit(0)).count() == 0


def test_a_long_text_of_many_secrets(spark):
    """Over 1 MB: work must not grow with the product of length and matches."""
    n = 50_000
    text = "é ".join(f"token=a{i:06d}xyz" for i in range(n))
    t = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secrets.scan(t).first().spans
    assert [(s.kind, s.start, s.end) for s in spans] == [(0, 18 * i, 18 * i + 16) for i in range(n)]
    assert secrets.redact(t).first().text == "é ".join(["[SECRET]"] * n)


def test_a_long_candidate_is_split_where_entropy_falls(spark):
    r = random.Random(5)
    hot = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    text = "0A" + hot() + "a" * 200 + hot() + " AccountKey=/" + "5F4DCC3B5AA765D61D8327DEB882CF99" + "/" + "b" * 300_000
    t = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [(s.start, s.end) for s in secrets.scan(t).first().spans if s.kind == 3]
    assert spans == brute.entropy_spans(text[:1000], secrets.WINDOW, secrets.HEX_BITS, secrets.MIXED_BITS, secrets.ALLOW)
    assert not any(a < 150 < b for a, b in spans) and len(spans) >= 3


def test_secrets_plan_has_no_python(spark):
    plan = secrets.scan(docs(spark, EDGE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = ["", " ", "a<|endoftext|>b <|endoftext|>", "\x1c\x1d\x85\xa0  x", "x" * 3000 + "y", "日本語 ١٢٣ ½ ² 'S 'll I'LL", "​　 a \n\n b", "ab" * 700, "\r\n\t x  \n\n", "ſ's", "🙂🙃👩‍👩‍👧", "the" * 200, "=" * 1000]


def test_codec_equals_the_library(library):
    codec = bpe.BpeCodec.from_json(open(tokenizer_path(), encoding="utf-8").read(), )
    r = random.Random(1)
    texts = ODD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x3000), r.randrange(0x1F300, 0x1F700), 32, 10])) for _ in range(r.randrange(1, 400))) for _ in range(300)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_long_and_short_words_agree():
    codec = bpe.BpeCodec.from_json(open(tokenizer_path(), encoding="utf-8").read())
    r = random.Random(2)
    for _ in range(200):
        w = "".join(r.choice("aeinrst ") for _ in range(r.randrange(1, 200))).encode()
        cuts, ids = codec.parts(w)
        assert ids == codec._long_parts(w)
        assert [w[a:b] for a, b in zip(cuts, cuts[1:])] == [codec.bytes_of[i] for i in ids]


def test_words_survive_one_change_of_generation():
    codec = bpe.BpeCodec.from_json(open(tokenizer_path(), encoding="utf-8").read())
    codec.words.most = 3
    texts = ["a bb ccc dddd eeeee"] * 3 + [" a bb", "zz yy xx ww vv uu tt"]
    fresh = bpe.BpeCodec.from_json(open(tokenizer_path(), encoding="utf-8").read())
    assert [codec.encode(t) for t in texts] == [fresh.encode(t) for t in texts]
    assert len(codec.words) <= 3 and len(codec.words.old) <= 3


def test_decoding_broken_utf8(library):
    codec = bpe.BpeCodec.from_json(open(tokenizer_path(), encoding="utf-8").read())
    ids = codec.encode("🙂")[:-1]
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_columns(spark, library):
    rows = [(i, t, None, None) for i, t in enumerate(ODD)] + EDGE
    t = docs(spark, rows).withColumn("ids", F.lit("clash"))
    out = bpe.round_trip(spark, t, tokenizer_path())
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert sorted((x.ids, x.decoded) for x in out.collect()) == sorted((library.encode(t or "", add_special_tokens=False).ids, t or "") for _, t, _, _ in rows)
    two = t.select(bpe.encode(spark, F.col("text"), tokenizer_path()).alias("e")).select("e", bpe.decode(spark, F.col("e"), tokenizer_path()).alias("d"))
    assert sorted((x.e, x.d) for x in two.collect()) == sorted((x.ids, x.decoded) for x in out.collect())
    assert bpe.round_trip(spark, t.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("change", [{"byte_fallback": True}, {"end_of_word_suffix": "</w>"}, {"dropout": 0.1}])
def test_options_that_change_ids_are_refused(change):
    j = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    j["model"] |= change
    with pytest.raises(ValueError):
        bpe.BpeCodec.from_json(json.dumps(j))


def test_tokens_with_strip_options_are_refused():
    j = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    j["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        bpe.BpeCodec.from_json(json.dumps(j))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.BpeCodec.from_json('{"model": {"type": "WordPiece", "vocab": {}, "merges": []}}')
