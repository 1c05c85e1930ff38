"""Text functions whose meaning differs between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similar_to(value: Column, pattern: str, escape: str = "\\") -> Column:
    """SQL's SIMILAR TO: % and _ as in LIKE, | * + ? () [] {} as in regular expressions, the whole string must match."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
        elif c == "%":
            out.append("(?s:.*)")
        elif c == "_":
            out.append("(?s:.)")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return value.rlike(f"^(?:{''.join(out)})$")


def concat_skip_null(*parts: Column) -> Column:
    """concat() that leaves nulls out, as most databases have it; || gives null."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def regexp_replace_first(value: Column, pattern: str, by: str) -> Column:
    """Replace the first match only (what a database does without the g flag)."""
    return F.regexp_replace(value, f"(?s)^(.*?)(?:{pattern})", f"$1{by}")


def trunc_number(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def array_contains_all(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.size(F.array_except(b, a)) == 0
