"""Aggregates that Spark spells otherwise, and sketches that are stored and merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_agg(value: Column, *order: Column, descending: bool = False) -> Column:
    """array_agg(value ORDER BY order): nulls are kept, which collect_list alone would drop."""
    pairs = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    return F.transform(F.reverse(pairs) if descending else pairs, lambda x: x["v"])


def string_agg(value: Column, separator: str, *order: Column) -> Column:
    """string_agg(value, separator ORDER BY order); nulls are left out."""
    return F.array_join(array_agg(value, *order), separator)


def json_agg(value: Column, *order: Column) -> Column:
    """json_agg(value ORDER BY order) as text."""
    return F.to_json(array_agg(value, *order), {"ignoreNullFields": "false"})


def json_object_agg(key: Column, value: Column) -> Column:
    """An object of keys and values as text, keys in order; of equal keys the largest value stays."""
    pairs = F.array_sort(F.collect_set(F.struct(key.alias("k"), value.alias("v"))))
    last = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i + 1)["k"] != p["k"], F.lit(True)))
    return F.to_json(F.map_from_entries(last), {"ignoreNullFields": "false"})


def rank_of(value: Column, x) -> Column:
    """The share of values that are at most x (the percentile that x is)."""
    return F.avg((value <= x).cast("double"))


def sum_wide(value: Column) -> Column:
    """sum() of longs that may exceed a long: as a number of 38 digits."""
    return F.sum(value.cast("decimal(38,0)"))


def distinct_sketch(value: Column, lg_k: int = 12) -> Column:
    """A mergeable sketch (HLL) of distinct values, for storage in a rollup."""
    return F.hll_sketch_agg(value, lg_k)


def distinct_merge(sketch: Column) -> Column:
    return F.hll_union_agg(sketch)


def distinct_estimate(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_sketch(value: Column) -> Column:
    """A mergeable sketch (KLL) of a distribution, for storage in a rollup."""
    return F.call_function("kll_sketch_agg_double", value)


def quantile_merge(sketch: Column) -> Column:
    return F.call_function("kll_merge_agg_double", sketch)


def quantile_of(sketch: Column, q: float) -> Column:
    return F.call_function("kll_sketch_get_quantile_double", sketch, F.lit(q))


def quantile_rank(sketch: Column, x: float) -> Column:
    return F.call_function("kll_sketch_get_rank_double", sketch, F.lit(x))


def top_sketch(value: Column, size: int = 10000) -> Column:
    """A mergeable sketch of frequent items."""
    return F.call_function("approx_top_k_accumulate", value, F.lit(size))


def top_merge(sketch: Column, size: int = 10000) -> Column:
    return F.call_function("approx_top_k_combine", sketch, F.lit(size))


def top_items(sketch: Column, k: int) -> Column:
    """array<struct<item, count>> of the k most frequent items."""
    return F.call_function("approx_top_k_estimate", sketch, F.lit(k))
