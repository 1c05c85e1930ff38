"""Quantile digests as columns: built, stored, merged and asked.

A digest is an array of centroids (mean, weight) in order of mean. Values that lie near each other in
rank share a centroid; the scale is the arcsine, so that centroids near both ends are small and
extreme quantiles are sharp. A digest of compression c has about c centroids however many values it saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.session import ship

DIGEST = "array<struct<mean:double,weight:double>>"
#: Groups that a partition holds before their digests are handed on.
HELD_GROUPS = 10_000
#: Partial digests of a group are merged in so many parts first.
PARTS = 64


def cluster(mean: np.ndarray, weight: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray]:
    """At most compression + 1 centroids of weighted values; finite weights above 0."""
    order = np.argsort(mean, kind="stable")
    mean, weight = mean[order], weight[order]
    middle = (np.cumsum(weight) - weight / 2) / weight.sum()
    place = np.floor(compression * (np.arcsin(2 * middle - 1) / np.pi + 0.5)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    total = np.add.reduceat(weight, first)
    return np.add.reduceat(mean * weight, first) / total, total


def _rows(mean: np.ndarray, weight: np.ndarray) -> list[dict[str, float]]:
    return [{"mean": m, "weight": w} for m, w in zip(mean.tolist(), weight.tolist(), strict=True)]


def tdigest(df: DataFrame, keys: list[str], value: str, compression: int = 100) -> DataFrame:
    """keys and digest of the values of each group, in two phases: partitions make digests of their rows, which are then merged. Null and NaN values are left out; a group without values has no row."""
    ship(df.sparkSession)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pd.DataFrame:
            some = pd.DataFrame([list(k) for k in held], columns=keys, dtype=object)
            some["digest"] = [_rows(*d) for d in held.values()]
            return some

        for batch in batches:
            for key, own in batch.groupby(keys, dropna=False, sort=False)["_value"]:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                mean, weight = own.to_numpy(float), np.ones(len(own))
                if key in held:
                    mean, weight = np.concatenate([held[key][0], mean]), np.concatenate([held[key][1], weight])
                held[key] = cluster(mean, weight, compression)
            if len(held) >= HELD_GROUPS:
                yield out()
                held = {}
        if held:
            yield out()

    rows = df.select(*keys, F.col(value).cast("double").alias("_value")).where("_value is not null and not isnan(_value)")
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), f"digest {DIGEST}"])
    parts = rows.mapInPandas(partial, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    return merge(merge(parts, [*keys, "_part"], "digest", compression), keys, "digest", compression)


def merge(df: DataFrame, keys: list[str], digest: str, compression: int = 100) -> DataFrame:
    """keys and digest: the digests of each group as one. Null digests are left out."""
    ship(df.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        every = [c for d in pdf[digest] for c in d]
        mean, weight = cluster(np.array([c["mean"] for c in every]), np.array([c["weight"] for c in every]), compression)
        out = pdf[keys].iloc[:1].copy()
        out["digest"] = [_rows(mean, weight)]
        return out

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), f"digest {DIGEST}"])
    filled = df.where(F.size(digest) > 0).select(*keys, digest)
    return filled.groupBy(*keys).applyInPandas(one, schema)


def weight(digest: Column) -> Column:
    """How many values a digest saw."""
    return F.aggregate(digest, F.lit(0.0), lambda acc, c: acc + c["weight"])


def _walk(digest: Column, hit, between, after: Column) -> Column:
    """The first centroid for which hit(middle rank, mean) holds gives between(previous middle, previous mean, middle, mean); none, after."""
    none = F.lit(None).cast("double")
    begin = F.struct(F.lit(0.0).alias("below"), none.alias("middle"), none.alias("mean"), none.alias("found"))

    def step(acc: Column, c: Column) -> Column:
        middle = acc["below"] + c["weight"] / 2
        found = F.when(acc["found"].isNull() & hit(middle, c["mean"]), between(acc["middle"], acc["mean"], middle, c["mean"])).otherwise(acc["found"])
        return F.struct((acc["below"] + c["weight"]).alias("below"), middle.alias("middle"), c["mean"].alias("mean"), found.alias("found"))

    return F.aggregate(digest, begin, step, lambda acc: F.coalesce(acc["found"], after))


def percentile(digest: Column, quantiles: Column) -> Column:
    """array<double>: the values at quantiles (an array), between the centroids around each; null for an empty digest."""
    last = F.element_at(digest, -1)["mean"]
    line = lambda q: lambda m0, x0, m, x: F.when(m0.isNull(), x).otherwise(x0 + (x - x0) * (q * weight(digest) - m0) / (m - m0))
    return F.when(F.size(digest) > 0, F.transform(quantiles, lambda q: _walk(digest, lambda m, _: m >= q * weight(digest), line(q), last)))


def percentile_of(digest: Column, values: Column) -> Column:
    """array<double>: the shares of values that are at most each of values (an array); null for an empty digest."""
    line = lambda v: lambda m0, x0, m, x: F.when(m0.isNull(), F.lit(0.0)).otherwise((m0 + (m - m0) * (v - x0) / (x - x0)) / weight(digest))
    return F.when(F.size(digest) > 0, F.transform(values, lambda v: _walk(digest, lambda _, x: x > v, line(v), F.lit(1.0))))
