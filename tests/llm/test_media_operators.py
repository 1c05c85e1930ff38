"""Embeddings, WARC, AVI and chat: against plain versions, exact round trips, and at the edges."""

from __future__ import annotations

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from shardloom.llm import avi, chat, egojoin, warc
from tests.llm import brute

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def plain_links(rows, cosine=0.9):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, links = Counter(), []
    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                n[i] += 1
                n[j] += 1
                links.append((i, j))
    low = brute.reach(sorted({i for i, _, _ in rows if i is not None}), links)
    return {i: (n[i], low[i], low[i] == i) for i in low}


@pytest.mark.parametrize("dim", [3, 16])
def test_ego_join_is_exact(spark, dim, monkeypatch):
    monkeypatch.setattr(egojoin, "BLOCK_ROWS", 50)
    monkeypatch.setattr(egojoin, "LEAF", 16)
    r = np.random.default_rng(dim)
    centre = r.normal(size=(12, dim))
    x = np.concatenate([r.normal(size=(150, dim)), centre[r.integers(0, 12, 150)] + 0.15 * r.normal(size=(150, dim)), np.repeat(centre[:1], 40, axis=0)])
    rows = [(int(i), [float(c) for c in np.float32(v)], 0) for i, v in zip(r.permutation(len(x)), x)]
    got = {t.vec_id: (t.n_links, t.component_id, t.kept) for t in egojoin.near_vectors(vectors(spark, rows)).collect()}
    assert got == plain_links(rows)


@pytest.mark.parametrize("turned", [512, 3])
def test_ego_join_with_blocks_of_few_bytes(spark, monkeypatch, turned):
    """Many blocks, several strips of them, boxes of fewer axes than the vectors have, copies of one vector."""
    for name, value in {"BLOCK_ROWS": 4, "FEW_BLOCKS": 2, "BLOCK_BYTES": 8 * 6 * 10, "LEAF": 4, "STRIP": 3, "BOX_AXES": 2, "TURN_DIMS": turned}.items():
        monkeypatch.setattr(egojoin, name, value)
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(120, 6)), np.repeat(r.normal(size=(3, 6)), 30, axis=0) + 0.05 * r.normal(size=(90, 6))])
    rows = [(i, [float(c) for c in np.float32(v)], 0) for i, v in enumerate(x)] + [(500 + i, [float(c) for c in np.float32(x[0])], 1) for i in range(15)]
    got = {t.vec_id: (t.n_links, t.component_id, t.kept) for t in egojoin.near_vectors(vectors(spark, rows)).collect()}
    assert got == plain_links(rows)


def test_ego_join_at_the_edges(spark):
    inf = float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, inf], 0), (6, [float("nan"), 1.0], 0), (7, [1.0, 1.0], 0), (8, [2.0, 2.0], 1), (9, [1e-30, 1e-30], 2), (10, [1.0, 1.0], 3), (11, [-1.0, 1.0], 0), (12, [1.0, 1.0, 0.0], 0), (None, [1.0, 1.0], 0), (13, [3e38, 3e38], 0)]
    t = vectors(spark, rows).withColumn("id", F.lit("clash")).withColumn("vec", F.lit(1)).withColumn("kept", F.lit(2))
    out = egojoin.near_vectors(t)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in out.collect()}
    want = plain_links(rows)
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[7] == (4, 7, True) and got[13] == (4, 7, False) and got[None] == (0, None, True)
    assert egojoin.near_vectors(vectors(spark, [])).count() == 0
    assert egojoin.near_vectors(vectors(spark, [(1, [1.0, 2.0], 0)])).first().n_links == 0


def test_distant_intervals_are_skipped_and_near_ones_are_not():
    r = np.random.default_rng(0)
    y = np.sort(r.uniform(0, 100, (400, 2)), axis=0)
    lo, hi = egojoin._boxes(y, 10)
    pairs = set(egojoin.interval_pairs(lo, hi, 1.0))
    near = {(i // 10, j // 10) for i in range(400) for j in range(i, 400) if np.hypot(*(y[i] - y[j])) <= 1.0}
    assert near <= pairs and len(pairs) < 40 * 41 / 2 / 3


# --- WARC

PAGES = "page_id long, url string, html string"


def test_warc_round_trip_and_revisits(spark):
    r = random.Random(1)
    pool = [None, "", "<p>é🙂</p>", "x" * 200000, *("<html>" + "".join(r.choice("abc <>") for _ in range(r.randrange(500))) for _ in range(20))]
    rows = [(i, r.choice(["http://a/b?c", None, "bad\r\nurl\x00ü"]), r.choice(pool)) for i in range(300)]
    r.shuffle(rows)
    back = {x.page_id: x for x in warc.read(warc.write(spark.createDataFrame(rows, PAGES).withColumn("first", F.lit(9)).withColumn("SHA", F.lit(1)))).collect()}
    first: dict[bytes, int] = {}
    for i, _, h in sorted(rows):
        first.setdefault((h or "").encode(), i)
    assert len(back) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        x = back[i]
        assert (x.payload_bytes, x.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (x.record_type, x.refers_to) == (("response", None) if first[raw] == i else ("revisit", first[raw]))
        assert x.payload is None if first[raw] != i else bytes(x.payload) == raw


def test_warc_least_bytes_nulls_repeats_and_empty(spark, tmp_path):
    rows = [(5, "u", "ab"), (3, "u", "ab"), (4, "u", "long enough"), (9, "u", "long enough"), (None, "u", "long enough"), (4, "u", "long enough")]
    archives = warc.write(spark.createDataFrame(rows, PAGES), min_bytes=5)
    out = Counter((x.page_id, x.record_type, x.refers_to) for x in warc.read(archives).collect())
    assert out == Counter([(5, "response", None), (3, "response", None), (4, "response", None), (4, "response", None), (9, "revisit", 4), (None, "revisit", 4)])
    alone = [(None, None, "twice"), (None, "\r\n%0A é ", "twice"), (7, " padded ", "once"), (None, "", "once"), (8, "http://x/%0A?b=é", "x")]
    out = Counter((x.page_id, x.url, x.record_type, x.refers_to) for x in warc.read(warc.write(spark.createDataFrame(alone, PAGES))).collect())
    assert out == Counter([(None, None, "response", None), (None, "\r\n%0A é ", "response", None), (7, " padded ", "response", None), (None, "", "revisit", 7), (8, "http://x/%0A?b=é", "response", None)])
    with pytest.raises(ValueError):
        warc.write(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"))
    assert warc.export_files(archives, str(tmp_path / "w")) >= 1
    assert warc.read_files(spark, f"file://{tmp_path}/w").count() == 6
    assert warc.read(warc.write(spark.createDataFrame([], PAGES))).count() == 0


def test_archive_form():
    records = [warc.record(i, "http://x", b"<html>" + b"abc " * i, warc.sha1_base32(b""), i) for i in range(100)]
    data = warc.write_archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and data[8 + size : 12 + size] == struct.pack("<I", 0xFD2FB528)
    assert list(warc.read_archive(data)) == records
    few = [b"record %d " % i * 3 for i in range(4)]
    assert list(warc.read_archive(warc.write_archive(few))) == few
    assert len(data) - size < sum(len(zstandard.compress(r)) for r in records) / 2
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-5]))
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\0" * 20))


# --- AVI


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 70000])
def test_avi_keeps_every_byte(n):
    for raw in (np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes(), b"\xff" * n, bytes(n)):
        payload = raw + b"\0" * (max(64, -(-n // 64) * 64) - n)
        media = avi.encode_avi(payload)
        back, frame_s, clips, hist = avi.read_video(media)
        assert back == payload and frame_s == 0.04 and clips[0][0] == 0 and clips[-1][1] == len(hist)
        assert hist.sum() == len(hist) * hist[0].sum()


def test_general_decoder_agrees_with_the_fast_one():
    payload = np.random.default_rng(3).integers(0, 256, 640, dtype=np.uint8).tobytes()
    media = avi.encode_avi(payload)
    at, size = avi.read_riff(media).frames[0]
    j = avi._parse_jpeg(media[at : at + size])
    fast = avi._fast(j).astype(int)
    assert (np.where(fast < 128, fast - 255, fast) == avi._slow(j)[0].reshape(-1, 64)).all()


def _jpeg_of_other_make() -> bytes:
    """A 16 x 16 picture of three components, the first sampled twice each way: all coefficients 0 but the DC of the first block."""
    dc = bytes([0, 2] + [0] * 14) + bytes([0, 5])  # codes 00: size 0, 01: size 5
    ac = bytes([0, 1] + [0] * 14) + bytes([0])  # code 00: end of block
    bits = "01" + "10100" + "00" + ("00" + "00") * 5  # DC of +20, then blocks without anything
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    return (
        b"\xff\xd8" + avi._segment(0xDB, b"\0" + b"\x08" * 64) + avi._segment(0xC0, struct.pack(">BHHB", 8, 16, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        + avi._segment(0xC4, b"\x00" + dc + b"\x10" + ac) + avi._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    )


def test_frames_of_other_make_are_decoded():
    own, luma = avi.decode_frame(_jpeg_of_other_make())
    assert own is None and luma.shape == (4, 64)
    assert (luma == 128 + 20 * 8 // 8).all()  # the DC predictor carries 20 to all four blocks


def test_shots_and_index(spark):
    flat = lambda v, n: np.full((n, 32), 1) + np.eye(32)[v] * 1000
    hist = np.concatenate([flat(3, 10), flat(20, 5), flat(9, 8)])
    assert avi.shots(hist) == [(0, 10), (10, 15), (15, 23)]
    assert avi.shots(hist[:1]) == [(0, 1)] and avi.shots(hist[:0]) == []
    media = avi.encode_avi(bytes(64 * 200))
    cut = media.index(b"idx1")
    assert avi.read_riff(media[:4] + struct.pack("<I", cut - 8) + media[8:cut]).frames == avi.read_riff(media).frames
    with pytest.raises(ValueError):
        avi.read_riff(b"RIFFxxxxWAVE")
    with pytest.raises(ValueError):
        avi.read_riff(media[:-20])


def test_media_columns(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100), (4, "x" * 50000), (4, "x" * 50000), (None, "a")]
    t = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    back = avi.read(avi.store(t))
    got = sorted(back.collect(), key=repr)
    for x in got:
        text = {1: "", 2: "", 3: "é" * 100, 4: "x" * 50000, None: "a"}[x.doc_id]
        n, payload = avi.padded(text)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    clips = avi.clip_rows(back).collect()
    assert {c.doc_id for c in clips} == {1, 2, 3, 4, None} and all(c.end_s > c.start_s for c in clips)
    assert avi.read(avi.store(t.limit(0))).count() == 0


# --- chat

TURNS = "conv_id long, turn long, role string, text string"


def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        turns = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha(turns), len(loss), sha(loss))
    return out


def test_chat_reads_back_what_was_written(spark):
    r = random.Random(3)
    bits = ["\\", "\\\\", "</turn>", "</turn>\n", "<part/>", "###", "### ", "# ", "<", "/", "\\e", "\\p", "\\h", "\\c", "\n", ":", ":\n", "é🙂", "abc", "### Assistant: </turn> ok"]
    rows = []
    for c in range(120):
        for k in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant", "assistant", "system", "odd:\n###</turn>", "", None, "ro\\le"])
            text = None if r.random() < 0.05 else "".join(r.choice(bits) for _ in range(r.randrange(0, 12)))
            rows.append((c, r.choice([k, k, 0, None]), role, text))
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (500, 0, "assistant", "long " * 20000)]
    t = spark.createDataFrame(rows, TURNS).withColumn("t", F.lit("clash")).withColumn("b", F.lit(1))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.digest(t).collect()}
    assert got == plain_chat(rows)
    assert chat.digest(t.limit(0)).count() == 0


def test_chat_template_merges_and_escapes(spark):
    t = chat.with_probe(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], TURNS))
    out = {x.conv_id: x for x in chat.format_turns(t).collect()}
    assert out[1].formatted == "### user:\na<part/>b</turn>\n### assistant:\nc</turn>\n"
    assert [out[1].formatted[s.start : s.end] for s in out[1].loss_spans] == ["c"]
    probe = out[-7].formatted
    assert probe.count("</turn>") == 2 and probe.count("### ") == 2


def test_chat_plan_has_no_python(spark):
    plan = chat.digest(chat.with_probe(spark.createDataFrame([(1, 0, "user", "a")], TURNS).repartition(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_a_conversation_of_many_turns(spark):
    """Work must not grow with the square of the turns."""
    n = 20_000
    rows = [(1, i, "assistant" if i % 3 else "user", f"turn {i} ### é") for i in range(n)]
    x = chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    loss = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (x.n_turns, x.loss_chars, x.loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert x.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
