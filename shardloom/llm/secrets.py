"""Secret scans in DataFrame functions only: patterns, and sliding-window entropy over candidate strings.

Positions: Java's regular expressions give the matches (regexp_extract_all) and what lies between
them (split), so a running sum of lengths gives each match's place in code points.

Entropy: a candidate is a maximal run of 20 or more letters, digits and + / _ = -. Two classes of
characters are looked at: the whole candidate as mixed letters and digits, unless it is hexadecimal, and
each maximal run of 20 or more hexadecimal digits in it. Each class has its threshold; strings
of letters alone or digits alone have none and give no span. A window of WINDOW
characters slides over a string; the counts of its characters, packed 12 to a 64-bit number, and the
sum of c * log2(c) are updated by the character that enters and the one that leaves, so no window is counted
anew. Windows whose Shannon entropy reaches the threshold make spans; those that overlap or touch
make one. Candidates on the allow list give none.

Texts may be of any length: work grows with the text and the number of matches, not with their product.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import bind, cut, fresh, need, sweep

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
HEX_RUN = rf"(?<![0-9a-fA-F])[0-9a-fA-F]{{{WINDOW},}}"
#: The codes of a candidate's characters go from + to z; counts of up to 31 take 5 bits.
LOWEST, CODES, PACKED, BITS = ord("+"), ord("z") - ord("+") + 1, 12, 5
#: Bits per character that a window must reach; a window of 20 random characters has about 3.3 of 16 and 4.1 of 64.
HEX_BITS, MIXED_BITS = 2.8, 3.7
#: Candidates that match one of these are no secrets: UUIDs, integrity digests by name, documented examples.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?i)sha(1|224|256|384|512)[-_=]",
    r"EXAMPLE",
)

SPAN = "struct<start:int,kind:int,end:int>"
SPANS = f"array<{SPAN}>"


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, hit>>: the matches of a pattern. A text without any is searched once."""
    kind = "struct<start:int,hit:string>"

    def place(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        items = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap")))

        def step(at: Column, x: Column):
            start = at + x["gap"]
            return start + F.length(x["hit"]), F.struct(start.alias("start"), x["hit"].alias("hit")), F.lit(True)

        return bind(items, lambda i: sweep(i, step, kind)["out"])

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, F.array().cast(f"array<{kind}>")).otherwise(place(hits)))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["hit"])).alias("end")).cast(SPAN))


def _plog(c: Column) -> Column:
    """c * log2(c) for a count from 0 to WINDOW + 1: a character enters before the oldest leaves."""
    return F.element_at(F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)]), c + 1)


def hot_regions(codes: Column, bits: Column) -> Column:
    """array<struct<first, last>>: the stretches of windows of at least these bits, last exclusive.

    codes: a bound variable, the codes of a string's characters less LOWEST.
    """
    kind = "array<struct<first:int,last:int>>"
    at = lambda c: F.struct((c / PACKED).cast("int").alias("word"), (c % PACKED * BITS).alias("shift"), c.alias("c"))
    moves = F.transform(codes, lambda c, i: F.struct(at(c).alias("new"), F.when(i >= WINDOW, at(F.get(codes, i - WINDOW))).alias("old"), (i + 1).alias("i")))
    none = F.lit(None).cast("int")
    empty = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-CODES // PACKED)).alias("n"), F.lit(0.0).alias("s"), none.alias("first"), none.alias("last"), F.array().cast(kind).alias("out"))
    unit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p["shift"])
    count = lambda n, p: F.call_function("shiftright", F.get(n, p["word"]), p["shift"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(acc: Column, m: Column) -> Column:
        new, old, gone = m["new"], m["old"], m["old"].isNotNull()
        plus = count(acc["n"], new)
        minus = count(acc["n"], old) + F.when(old["c"] == new["c"], 1).otherwise(0)
        s = acc["s"] + _plog(plus + 1) - _plog(plus) + F.when(gone, _plog(F.greatest(minus - 1, F.lit(0))) - _plog(minus)).otherwise(0.0)
        moved = F.transform(acc["n"], lambda w, k: w + F.when(k == new["word"], unit(new)).otherwise(0) - F.when(gone & (k == old["word"]), unit(old)).otherwise(0))
        hot = (m["i"] >= WINDOW) & (F.lit(math.log2(WINDOW)) - s / WINDOW >= bits)
        begin = m["i"] - WINDOW
        apart = hot & (begin > acc["last"])
        return F.struct(
            F.when(gone & (old["c"] == new["c"]), acc["n"]).otherwise(moved).alias("n"),
            s.alias("s"),
            F.when(hot & F.coalesce(apart, F.lit(True)), begin).otherwise(acc["first"]).alias("first"),
            F.when(hot, m["i"]).otherwise(acc["last"]).alias("last"),
            F.when(apart, F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(moves, empty, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))))


def _strings(x: Column) -> Column:
    """array<struct<start, word, bits>>: what is looked at in a candidate."""
    whole = F.array(F.struct(x["start"].alias("start"), x["hit"].alias("word"), F.lit(MIXED_BITS).alias("bits")))
    hexes = F.transform(_found(x["hit"], HEX_RUN), lambda h: F.struct((x["start"] + h["start"]).alias("start"), h["hit"].alias("word"), F.lit(HEX_BITS).alias("bits")))
    some = F.when(x["hit"].rlike("^[0-9a-fA-F]+$"), hexes).otherwise(F.concat(whole, hexes))
    return F.filter(some, lambda w: w["word"].rlike("[0-9]") & w["word"].rlike("[A-Za-z]"))


def _entropy(text: Column) -> Column:
    """Spans of high entropy within candidates."""
    allowed = lambda x: x["hit"].rlike("|".join(f"(?:{a})" for a in ALLOW)) if ALLOW else F.lit(False)
    strings = F.flatten(F.transform(F.filter(_found(text, CANDIDATE), lambda x: ~allowed(x)), _strings))
    codes = lambda w: F.transform(F.split(w["word"], "", -1), lambda c: F.ascii(c) - LOWEST)
    regions = lambda w: F.transform(
        bind(codes(w), lambda c: hot_regions(c, w["bits"])),
        lambda r: F.struct((w["start"] + r["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (w["start"] + r["last"]).alias("end")).cast(SPAN),
    )
    return F.array_distinct(F.flatten(F.transform(strings, regions)))


def spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of all secrets of a whole text, in order; kind is a place in KINDS, end is exclusive.

    Null and empty texts have none. Spans of different kinds may overlap.
    """
    t = F.coalesce(text, F.lit(""))
    found = F.concat(
        _spans(F.filter(_found(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= ASSIGN_LEAST), 0),
        # A run is taken whole, so asking for its least length in the pattern drops the same matches and skips short runs fast
        _spans(_found(t, "AKIA[A-Z0-9]" + f"{{{ACCESS_LEAST - 4},}}"), 1),
        _spans(_found(t, "(?<![0-9a-f])[0-9a-f]" + f"{{{HEX_LEAST},}}"), 2),
        _entropy(t),
    )
    return F.array_sort(found)


def span_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans of documents (doc_id, text); other columns are left out. One row for each row, no shuffle."""
    need(docs, "doc_id", "text")
    return docs.select("doc_id", spans(F.col("text")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret of text replaced by mark, overlapping ones by one mark; n_chars, if it is there, is counted anew.

    All rows and all other columns stay; null texts stay null.
    """
    need(docs, "text")
    found = fresh(docs, "found")[0]
    text = F.col("text")
    gap = lambda at, s: (F.greatest(at, s["end"]), F.struct(at.alias("start"), s["start"].alias("end")), s["start"] >= at)
    marked = lambda r: F.concat(F.array_join(F.transform(cut(text, r["out"]), lambda x: F.concat(x, F.lit(mark))), ""), F.substring(text, r["at"] + 1, F.length(text)))
    clean = bind(sweep(F.col(found), gap, "struct<start:int,end:int>"), marked)
    out = docs.withColumn(found, spans(text)).withColumn("text", F.when(F.size(found) > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(found)
