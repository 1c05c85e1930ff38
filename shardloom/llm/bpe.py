"""BPE encoding and decoding with a contiguous rank array.

A word is held as short arrays: the boundaries of its parts, beside them the parts' ids, and for each
pair of neighbouring parts the rank of their merge. The smallest rank is searched by a scan, its
boundary is deleted, and the ranks to the left and right of it are looked up anew, until no pair has
a rank. A pair of parts is one whole number, left id * SPAN + right id, so a look-up cuts and hashes no
bytes. Words of over LONG_WORD bytes (runs without any break) use a heap over the same arrays
instead, which takes n log n steps where repeated scans would take n * n.

Encoded words are kept as packed 32-bit ids in two generations: when the young one is full it
becomes the old one, so words in use outlive a change and memory is bounded by 2 * CACHE_WORDS words.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import need, only
from shardloom.session import ship

#: Fixed value: how the byte-level vocabularies cut a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256
#: Words of a generation of the cache: about 20 MB.
CACHE_WORDS = 150_000
NO_RANK = 1 << 60


def byte_letters() -> dict[str, int]:
    """Byte of each letter by which byte-level vocabularies spell bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Words(dict):
    """Packed ids of words; what isn't among the young is taken over from the old, or encoded."""

    def __init__(self, codec: BpeCodec, most: int) -> None:
        super().__init__()
        self.codec, self.most, self.old = codec, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("i", self.codec.encode_word(word.encode())).tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class BpeCodec:
    """Encoder and decoder of one byte-level vocabulary (a tokenizers JSON file)."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int], special: dict[str, int], cache_words: int = CACHE_WORDS) -> None:
        self.special = special
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        if lost := [b for b in range(256) if bytes([b]) not in vocab]:
            raise ValueError(f"the vocabulary lacks the bytes {lost}")
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.span = max(vocab.values()) + 1
        self.ranks = {vocab[a] * self.span + vocab[b]: r for (a, b), r in ranks.items()}
        self.made = [0] * (max(ranks.values(), default=-1) + 1)
        for (a, b), r in ranks.items():
            self.made[r] = vocab[a + b]
        self.find = regex.compile(WORD_PATTERN).findall
        self.marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = _Words(self, cache_words)

    @classmethod
    def from_json(cls, text: str) -> BpeCodec:
        """From the text of the vocabulary file. Other kinds than byte-level BPE without options raise ValueError."""
        j = json.loads(text)
        model, pre, added = j["model"], j.get("pre_tokenizer") or {}, j.get("added_tokens", [])
        odd = [o for o in ("dropout", "ignore_merges", "byte_fallback", "fuse_unk", "continuing_subword_prefix", "end_of_word_suffix") if model.get(o)]
        odd += [f"{t['content']}: {o}" for t in added for o in ("lstrip", "rstrip", "single_word") if t.get(o)]
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or j.get("normalizer") or (j.get("decoder") or pre).get("type") != "ByteLevel" or odd:
            raise ValueError(f"only plain byte-level BPE files are supported {odd or ''}")
        letter = byte_letters()
        spell = lambda s: bytes(letter[c] for c in s)
        special = {t["content"]: t["id"] for t in added}
        vocab = {spell(s): i for s, i in model["vocab"].items() if s not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return cls(vocab, {(spell(a), spell(b)): k for k, (a, b) in enumerate(pairs)}, special)

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        return self._long_parts(word) if len(word) > LONG_WORD else self.parts(word)[1]

    def parts(self, word: bytes) -> tuple[list[int], list[int]]:
        """Boundaries of a word's parts (one more than there are parts), and the parts' ids."""
        rank, made, span = self.ranks.get, self.made, self.span
        ids = list(map(self.byte_ids.__getitem__, word))
        cuts = list(range(len(word) + 1))
        ranks = [rank(a * span + b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)  # of equal ranks the leftmost goes first
            del cuts[i + 1], ranks[i], ids[i + 1]
            ids[i] = new = made[least]
            if i < len(ranks):
                ranks[i] = rank(new * span + ids[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank(ids[i - 1] * span + new, NO_RANK)
        return cuts, ids

    def _long_parts(self, word: bytes) -> list[int]:
        n, rank, made, span = len(word), self.ranks.get, self.made, self.span
        ids = list(map(self.byte_ids.__getitem__, word))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the next and the last part of each part; n: none

        def pair(i: int) -> int:
            return rank(ids[i] * span + ids[after[i]], NO_RANK) if after[i] < n else NO_RANK

        now = [pair(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(now) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            gone = after[i]
            ids[i], after[i], now[gone] = made[r], after[gone], -1
            if after[gone] < n:
                before[after[gone]] = i
            for k in (i, before[i]):
                if k >= 0:
                    now[k] = pair(k)
                    if now[k] != NO_RANK:
                        heapq.heappush(heap, (now[k], k))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def pack(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit numbers; the strings of special tokens in it become these tokens, as the library has it by default."""
        packed = self.words.__getitem__
        if not self.marks:
            return b"".join(map(packed, self.find(text)))
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += map(packed, self.find(text[at : m.start()]))
            out.append(array("i", [self.special[m[0]]]).tobytes())
            at = m.end()
        out += map(packed, self.find(text[at:] if at else text))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return array("i", self.pack(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as an array of lists, without a Python number for each id."""
    ends = np.cumsum([0, *(len(p) >> 2 for p in packed)], dtype=np.int64)
    flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)


def _load(text: str) -> BpeCodec:
    """The codec of a file; a reused Python worker keeps it, with its word cache, for its next tasks."""
    return only(("bpe", text), lambda: BpeCodec.from_json(text))


def _codec(spark: SparkSession, tokenizer_path: str):
    """A broadcast of the vocabulary file's text (about 1.5 MB, whatever the input), read on the driver."""
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, text: Column, tokenizer_path: str) -> Column:
    """array<int>: the ids of each text. Null and empty texts have none."""
    file = _codec(spark, tokenizer_path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _load(file.value)
        for texts in batches:
            yield pd.Series([np.frombuffer(codec.pack(t or ""), np.int32) for t in texts])

    return ids(text)


def decode(spark: SparkSession, ids: Column, tokenizer_path: str) -> Column:
    """string: the text of each array of ids; null for null, an unknown id raises KeyError."""
    file = _codec(spark, tokenizer_path)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _load(file.value)
        for rows in batches:
            yield pd.Series([None if r is None else codec.decode(r.tolist()) for r in rows], dtype=object)

    return texts(ids)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of documents (doc_id, text); other columns are left out.

    One pass of Python workers and no shuffle: a text is encoded and its ids are decoded in the same
    batch. A null text counts as empty: no ids, and the empty string.
    """
    need(docs, "doc_id", "text")
    file = _codec(spark, tokenizer_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _load(file.value)
        for batch in batches:
            packed = [codec.pack(t or "") for t in batch.column("text").to_pylist()]
            texts = pa.array((codec.decode(array("i", p)) for p in packed), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(packed), texts], names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids array<int>, decoded string")
