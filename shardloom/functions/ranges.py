"""Range types as structs (lower, upper, lower_inc, upper_inc); a null bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    """A range; bounds as in [), [], (], ()."""
    if len(bounds) != 2 or bounds[0] not in "[(" or bounds[1] not in ")]":
        raise ValueError("bounds are one of [) [] (] ()")
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(bounds[0] == "[").alias("lower_inc"), F.lit(bounds[1] == "]").alias("upper_inc"))


def is_empty(r: Column) -> Column:
    """True if no value lies in the range."""
    closed = r["lower_inc"] & r["upper_inc"]
    return F.coalesce((r["lower"] > r["upper"]) | ((r["lower"] == r["upper"]) & ~closed), F.lit(False))


def contains(r: Column, x: Column) -> Column:
    """r @> x for a value x."""
    low = r["lower"].isNull() | (x > r["lower"]) | (r["lower_inc"] & (x == r["lower"]))
    high = r["upper"].isNull() | (x < r["upper"]) | (r["upper_inc"] & (x == r["upper"]))
    return low & high


def overlaps(a: Column, b: Column) -> Column:
    """a && b: some value lies in both."""

    def before(x: Column, y: Column) -> Column:
        """x ends before y begins."""
        return F.coalesce((x["upper"] < y["lower"]) | ((x["upper"] == y["lower"]) & ~(x["upper_inc"] & y["lower_inc"])), F.lit(False))

    return ~before(a, b) & ~before(b, a) & ~is_empty(a) & ~is_empty(b)


def enum_rank(value: Column, labels: list[str]) -> Column:
    """The place of an enum's label in its declaration: what enums are ordered by; null for null, an error for an unknown label."""
    place = F.array_position(F.array(*map(F.lit, labels)), value)
    return F.when(place == 0, F.raise_error(F.concat(F.lit("not a label: "), value)).cast("long")).otherwise(place)


def domain(value: Column, check: Column, name: str) -> Column:
    """value if check isn't false (null passes, as for a domain), an error otherwise."""
    kept = F.coalesce(check, F.lit(True))
    return F.when(kept, value).otherwise(F.raise_error(F.lit(f"value violates domain {name}")))
