"""AVI motion-JPEG: a lossless store of bytes, a reader of RIFF indexes and frames, shots as timed clips.

Store. The unit of a JPEG frame is the quantised coefficient, and that is where the bytes go: 64
bytes make one block of 8 x 8 coefficients, in zigzag order. Byte b stands for the coefficient
b - 255 below 128 and b from there on, the 256 numbers of magnitude category 8, whose extra bits are
b itself. With a Huffman table of a single code (one bit) for that category, a block takes 64 x 9
bits, which is 72 whole bytes, and restart markers after each block keep the DC predictor at 0. All
of this is baseline JPEG, which any decoder shows as pictures; no bit of the payload is rounded.

Read. read_riff() walks the RIFF chunks, index() takes the frames' places from idx1 (or from the movi
list where there is none), decode_frame() parses a frame's tables and entropy-codes: frames with the
tables above by array operations, all other baseline frames (Huffman tables, sampling factors and
restart intervals of any kind) bit by bit.

Shots. Each frame gives a histogram of its luminance. The difference of neighbouring histograms is a
cut if it exceeds the mean of the differences in a window around it by FACTOR standard deviations,
and a floor; clips lie between cuts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import need
from shardloom.session import ship

BLOCK = 64
#: Blocks of a frame at most: 64 x 64 samples. A shorter payload has one frame of a single row of blocks.
FRAME_BLOCKS = 64
FPS = 25
BINS = 32
CUT_WINDOW, CUT_FACTOR, CUT_FLOOR = 8, 2.0, 0.25
ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in ((i, s - i) if s % 2 else (s - i, i) for i in range(s + 1)) if y < 8 and x < 8])
_COS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(w: int, h: int) -> bytes:
    """All of a frame up to its coded data: one component, quantisation by 1, one-code tables, restarts after each block."""
    lone = bytes([1] + [0] * 15)
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\0" + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHB3B", 8, h, w, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + lone + b"\x08" + b"\x10" + lone + b"\x08"),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def encode_frame(blocks: np.ndarray, wide: int) -> bytes:
    """A JPEG of (n, 64) bytes, n a multiple of wide, which is the number of blocks in a row."""
    n = len(blocks)
    bits = np.zeros((n, 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(blocks.reshape(n, 64, 1), axis=2)
    coded = np.empty((n, 74), np.uint8)
    coded[:, :72] = np.packbits(bits.reshape(n, 576), axis=1)
    coded[:, 72] = 0xFF
    coded[:, 73] = 0xD0 + np.arange(n) % 8
    marks = np.zeros((n, 74), bool)
    marks[:, 72] = True
    flat = coded.reshape(-1)[:-2]  # none after the last block
    stuffed = np.repeat(flat, 1 + ((flat == 0xFF) & ~marks.reshape(-1)[:-2]))
    again = np.flatnonzero((flat == 0xFF) & ~marks.reshape(-1)[:-2])
    stuffed[again + np.arange(1, len(again) + 1)] = 0  # an 0xFF of the data is followed by 0
    return _frame_head(8 * wide, 8 * (n // wide)) + stuffed.tobytes() + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """An AVI of a payload whose length is a positive multiple of 64. Its length is kept in the INFO list."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    n = len(data)
    wide, per = (n, n) if n < FRAME_BLOCKS else (8, FRAME_BLOCKS)
    frames = -(-n // per)
    if frames * per > n:
        data = np.concatenate([data, np.zeros((frames * per - n, BLOCK), np.uint8)])
    pictures = [encode_frame(data[i * per : (i + 1) * per], wide) for i in range(frames)]
    w, h = 8 * wide, 8 * (per // wide)
    most = max(map(len, pictures))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, frames, 0, 1, most, w, h, 0, 0, 0, 0)
    strh = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, frames, most, -1, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    info = b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d\0" % len(payload))
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, idx, at = [b"movi"], [], 4
    for p in pictures:
        idx.append(b"00dc" + struct.pack("<III", 0x10, at, len(p)))
        movi.append(_chunk(b"00dc", p))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(idx))
    return _chunk(b"RIFF", body)


@dataclass
class Avi:
    """What read_riff finds: seconds per frame, the frames' places in the file, and comments."""

    frame_s: float = 1 / FPS
    frames: list[tuple[int, int]] = field(default_factory=list)
    comment: str = ""


def read_riff(data: bytes) -> Avi:
    """Parse an AVI. ValueError where it isn't one or is cut off; unknown chunks are skipped."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    out, movi, idx, loose = Avi(), 0, b"", []

    def walk(at: int, end: int) -> None:
        nonlocal movi, idx
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if at + 8 + size > len(data):
                raise ValueError(f"chunk {name!r} is cut off")
            if name == b"LIST":
                movi = at + 8 if data[at + 8 : at + 12] == b"movi" else movi
                walk(at + 12, at + 8 + size)
            elif name == b"avih":
                out.frame_s = struct.unpack_from("<I", data, at + 8)[0] / 1e6
            elif name == b"ICMT":
                out.comment = data[at + 8 : at + 8 + size].rstrip(b"\0").decode("utf-8", "replace")
            elif name == b"idx1":
                idx = data[at + 8 : at + 8 + size]
            elif name[2:] in (b"dc", b"db"):
                loose.append((at + 8, size))
            at += 8 + size + size % 2

    walk(12, 8 + struct.unpack_from("<I", data, 4)[0])
    for k in range(0, len(idx) - 15, 16):
        name, _, at, size = struct.unpack_from("<4sIII", idx, k)
        if name[2:] in (b"dc", b"db"):
            base = movi if data[movi + at : movi + at + 4] == name else 0  # places count from the list or from the file's start
            out.frames.append((base + at + 8, size))
    out.frames = out.frames or loose
    return out


def _parse_jpeg(jpg: bytes) -> dict:
    """The tables and the coded data of a baseline JPEG."""
    if jpg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    j: dict = {"q": {}, "huff": {}, "restart": 0}
    at = 2
    while at + 4 <= len(jpg):
        marker, size = jpg[at + 1], struct.unpack_from(">H", jpg, at + 2)[0]
        body = jpg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                j["q"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(int)
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            _, j["h"], j["w"], n = struct.unpack_from(">BHHB", body)
            j["parts"] = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                j["huff"][body[0]] = counts, body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            j["restart"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            for i in range(body[0]):
                part = next(p for p in j["parts"] if p["id"] == body[1 + 2 * i])
                part["dc"], part["ac"] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            end = jpg.rfind(b"\xff\xd9")
            j["data"] = jpg[at : end if end >= at else len(jpg)]
            return j
    raise ValueError("a frame without data")


def _codes(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    """Symbol of each (length, code)."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[length, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


_LONE = (bytes([1] + [0] * 15), b"\x08")


def _fast(j: dict) -> np.ndarray | None:
    """Coefficient bytes (n, 64) of a frame in the form of encode_frame; None for other frames."""
    if len(j["parts"]) != 1 or j["restart"] != 1 or j["huff"].get(0) != _LONE or j["huff"].get(16) != _LONE:
        return None
    n = -(-j["w"] // 8) * -(-j["h"] // 8)
    raw = np.frombuffer(j["data"], np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    drop = np.zeros(len(raw), bool)
    drop[ff[after == 0] + 1] = True
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop[marks] = drop[marks + 1] = True
    raw = raw[~drop]
    if len(raw) != 72 * n or len(marks) != n - 1:
        return None
    bits = np.unpackbits(raw.reshape(n, 72), axis=1).reshape(n, 64, 9)
    return None if bits[:, :, 0].any() else np.packbits(bits[:, :, 1:], axis=2).reshape(n, 64)


def _value(extra: int, size: int) -> int:
    return extra if size and extra >> (size - 1) else extra - (1 << size) + 1


def _slow(j: dict) -> list[np.ndarray]:
    """Quantised coefficients in zigzag order, for each component (rows, columns, 64)."""
    parts = j["parts"]
    hm, vm = max(p["h"] for p in parts), max(p["v"] for p in parts)
    across, down = -(-j["w"] // (8 * hm)), -(-j["h"] // (8 * vm))
    out = [np.zeros((down * p["v"], across * p["h"], 64), int) for p in parts]
    tables = {k: _codes(t) for k, t in j["huff"].items()}
    pieces, data, at = [], j["data"], 0
    start = 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            pieces.append(data[start:at])
            start = at + 2
        at += 2
    pieces.append(data[start:])
    step = j["restart"] or across * down
    for k, piece in enumerate(pieces):
        piece = piece.replace(b"\xff\x00", b"\xff")
        bits, pos = "".join(f"{b:08b}" for b in piece) + "1" * 32, 0

        def symbol(table: dict) -> int:
            nonlocal pos
            code = 0
            for length in range(1, 17):
                code = code << 1 | (bits[pos] == "1")
                pos += 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("a code that no table has")

        def take(size: int) -> int:
            nonlocal pos
            pos += size
            return int(bits[pos - size : pos] or "0", 2)

        before = [0] * len(parts)
        for mcu in range(k * step, min((k + 1) * step, across * down)):
            for c, p in enumerate(parts):
                for v in range(p["v"]):
                    for h in range(p["h"]):
                        block = out[c][mcu // across * p["v"] + v, mcu % across * p["h"] + h]
                        size = symbol(tables[p["dc"]])
                        before[c] += _value(take(size), size) if size else 0
                        block[0] = before[c]
                        i = 1
                        while i < 64:
                            s = symbol(tables[16 + p["ac"]])
                            if s == 0:
                                break
                            i += s >> 4
                            if s & 15:
                                block[i] = _value(take(s & 15), s & 15)
                            i += 1
    return out


def samples(coefficients: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(n, 64) samples from 0 to 255 of (n, 64) quantised coefficients in zigzag order."""
    flat = np.zeros((len(coefficients), 64), np.float32)
    flat[:, ZIGZAG] = coefficients * q
    cos = _COS.astype(np.float32)
    return np.clip(np.rint(cos @ flat.reshape(-1, 8, 8) @ cos.T) + 128, 0, 255).astype(np.uint8).reshape(-1, 64)


def decode_frame(jpg: bytes) -> tuple[np.ndarray | None, np.ndarray]:
    """The stored bytes (None for frames of another make) and the luminance samples of the picture's blocks."""
    j = _parse_jpeg(jpg)
    stored = _fast(j)
    if stored is None:
        luma = _slow(j)[0].reshape(-1, 64)
    else:
        luma = stored.astype(np.int16)
        luma -= np.where(stored < 128, np.int16(255), np.int16(0))
    return stored, samples(luma, j["q"][j["parts"][0]["q"]])


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of frames (end exclusive) between cuts."""
    n = len(histograms)
    if n < 2:
        return [(0, n)] if n else []
    share = histograms / histograms.sum(axis=1, keepdims=True)
    d = np.abs(share[1:] - share[:-1]).sum(axis=1) / 2
    cuts = [0]
    for i, x in enumerate(d):
        near = np.delete(d[max(0, i - CUT_WINDOW) : i + CUT_WINDOW + 1], min(i, CUT_WINDOW))
        level = max(CUT_FLOOR, near.mean() + CUT_FACTOR * near.std()) if len(near) else CUT_FLOOR
        if x > level:
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], n]))


def read_video(data: bytes) -> tuple[bytes, float, list[tuple[int, int]], np.ndarray]:
    """The stored payload, seconds per frame, shots, and the histogram of each frame."""
    avi = read_riff(data)
    stored, hist = [], []
    for at, size in avi.frames:
        own, luma = decode_frame(data[at : at + size])
        if own is not None:
            stored.append(own.tobytes())
        hist.append(np.bincount(luma.reshape(-1) >> 3, minlength=BINS))
    payload = b"".join(stored)
    if avi.comment.startswith("payload_bytes="):
        payload = payload[: int(avi.comment.partition("=")[2])]
    hist = np.array(hist).reshape(-1, BINS)
    return payload, avi.frame_s, shots(hist), hist


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's length in UTF-8, and its bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (without padding), media binary: an AVI of each whole text.

    One row for each row, no shuffle; equal texts give equal media. A null text counts as empty, and an
    empty one is 64 zeros. Other columns are left out; an empty table gives an empty result.
    """
    need(docs, doc_id, text)
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, media = [], []
            for t in batch.column(1).to_pylist():
                size, payload = padded(t)
                n.append(size)
                media.append(encode_avi(payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(work, f"doc_id {kind}, n_bytes long, media binary")


CLIP = "struct<clip:int,start_s:double,end_s:double,frames:int,mean_luma:double>"


def read(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media_bytes, media_sha256, payload_sha256, tail_crc32, clips array<CLIP> of rows (doc_id, n_bytes, media).

    A null media gives nulls and no clips; a broken one raises ValueError.
    """
    need(media, "doc_id", "n_bytes", "media")
    ship(media.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                if data is None:
                    rows.append((None,) * 6)
                    continue
                payload, frame_s, parts, hist = read_video(data)
                luma = hist @ (np.arange(BINS) * 8 + 3.5)
                clips = [{"clip": k, "start_s": round(a * frame_s, 6), "end_s": round(b * frame_s, 6), "frames": b - a, "mean_luma": float(luma[a:b].sum() / hist[a:b].sum())} for k, (a, b) in enumerate(parts)]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), clips))
            clip = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("mean_luma", pa.float64())]))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<{CLIP}>")


def clip_rows(read_back: DataFrame) -> DataFrame:
    """One row for each clip: doc_id, clip, start_s, end_s, frames, mean_luma."""
    return read_back.select("doc_id", F.inline("clips"))
