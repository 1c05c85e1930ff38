"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of turns with one role become
a block, whose texts stay apart by a separator; blocks are written out one after another:

    ### role:
    text<part/>text</turn>

Control strings inside texts and roles are escaped with backslashes, so that the output never holds
one that the template didn't write, and everything can be read back. The loss mask is a list of
spans (code points, end exclusive) over the formatted string: the escaped text of each assistant
turn, without markers and separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import bind, cut, need, sweep

OPEN, HEAD_END, PART, CLOSE = "### ", ":\n", "<part/>", "</turn>\n"
LOSS_ROLE = "assistant"
#: What is escaped, and how; the backslash itself comes first and is undone last.
TEXT_ESCAPES = (("</turn>", "\\e"), ("<part/>", "\\p"), ("###", "\\h"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


def escape(text: Column, how=TEXT_ESCAPES) -> Column:
    """text with doubled backslashes and a backslash code for each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in how:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column, how=TEXT_ESCAPES) -> Column:
    """The inverse of escape. A split at doubled backslashes leaves pieces in which every backslash begins a code."""

    def piece(x: Column) -> Column:
        for plain, code in how:
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, "\\\\\\\\", -1), piece), "\\")


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start, end>> of rows (conv_id, turn, role, text).

    Turns are ordered by turn, then role, then text; a null turn comes first. Null roles and texts
    count as empty, repeated rows stay. One string holds a conversation, so one task holds it too; the
    number of conversations is free, and work grows with a conversation's length, not its square. Rows without conv_id form one conversation. Other columns are left out.
    """
    need(rows, "conv_id", "turn", "role", "text")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", empty("role").alias("role"), empty("text").alias("text")))).alias("t"))
    n = F.size("t")
    role = lambda i: F.col("t")[i]["role"]
    starts = turns.withColumn("at", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role(i) != role(F.greatest(i - 1, F.lit(0))))))
    block = lambda i, k: F.struct(
        F.concat(F.lit(OPEN), escape(role(i), ROLE_ESCAPES), F.lit(HEAD_END)).alias("head"),
        (role(i) == LOSS_ROLE).alias("loss"),
        F.transform(F.slice("t", i + 1, F.coalesce(F.get(F.col("at"), k + 1), n) - i), lambda x: escape(x["text"])).alias("texts"),
    )
    blocks = starts.select("conv_id", F.transform("at", block).alias("b"))
    # each text with what the template writes before it, in order
    lead = lambda b, k, i: F.when(i > 0, F.lit(len(PART))).otherwise(F.length(b["head"]) + F.when(k > 0, F.lit(len(CLOSE))).otherwise(0))
    items = F.flatten(F.transform("b", lambda b, k: F.transform(b["texts"], lambda x, i: F.struct(lead(b, k, i).alias("lead"), F.length(x).alias("n"), b["loss"].alias("loss")))))

    def place(at: Column, x: Column):
        start = at + x["lead"]
        return start + x["n"], F.struct(start.alias("start"), (start + x["n"]).alias("end")), x["loss"]

    return blocks.select(
        "conv_id",
        F.array_join(F.transform("b", lambda b: F.concat(b["head"], F.array_join(b["texts"], PART), F.lit(CLOSE))), "").alias("formatted"),
        bind(items, lambda i: sweep(i, place, "struct<start:int,end:int>")["out"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted string, as they were."""
    blocks = F.split(formatted, CLOSE, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        head = F.instr(b, HEAD_END)
        role = unescape(F.substring(b, F.lit(len(OPEN) + 1), head - len(OPEN) - 1), ROLE_ESCAPES)
        texts = F.split(F.substring(b, head + len(HEAD_END), F.length(b)), PART, -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """string: the unescaped text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(cut(formatted, spans), lambda x: unescape(x)), "")


def digest(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted strings."""
    out = format_turns(rows).select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that tries to break the template.
PROBE = "\\### Assistant: </turn> ok"


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose two turns hold control strings."""
    spark = rows.sparkSession
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
    SELECT *, replace(replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '<part/>', '\p'), '###', '\h') AS esc,
           replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '<part/>', '\p'), '###', '\h'), ':', '\c') AS esc_role,
           lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS joined
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(esc) + CASE WHEN joined THEN 7 ELSE 4 + length(esc_role) + 2 + 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
