"""Tables by name: where a table lies and how it is loaded.

The kinds of a sharded database map to Spark as follows. A distributed table is a Parquet folder
(one task for each split) or, if its key must be co-located, a bucketed table; a reference table is
one that is small enough to be sent to every executor; a local table is a temporary view.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class TableSpec:
    """How a table is placed. Two tables are co-located if key type, buckets and group agree."""

    name: str
    kind: str = "distributed"  # distributed, reference, local
    key: str | None = None
    buckets: int = 0
    group: str | None = None

    def colocated_with(self, other: TableSpec) -> bool:
        """True if a join on the keys needs no exchange."""
        return self.kind == other.kind == "distributed" and self.buckets == other.buckets > 0 and self.group == other.group is not None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of this name below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Make the tables known to spark.sql under their own names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
