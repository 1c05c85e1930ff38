"""Statistics of statements, plans as text or JSON, and whether an expression is volatile."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.sources.intermediate import shared_folder

_LITERAL = re.compile(r"'(?:[^']|'')*'|(?<![\w.])\d+(?:\.\d+)?")


def fingerprint(statement: str) -> str:
    """A statement with its literals as $1, $2, … and blanks as one."""
    seen = iter(range(1, len(statement) + 2))
    return " ".join(_LITERAL.sub(lambda _: f"${next(seen)}", statement).split())


class StatementStatistics:
    """Calls, rows and seconds by statement, kept below a folder of the shared place until reset()."""

    _SCHEMA = "statement string, calls long, rows long, seconds double"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.reset()

    def run(self, statement: str) -> DataFrame:
        """Run a statement once; its rows are stored, so that reading them doesn't run it again."""
        began, path = time.monotonic(), shared_folder(self.spark, "statement")
        self.spark.sql(statement).write.parquet(path)
        rows = self.spark.read.parquet(path)
        told = (fingerprint(statement), 1, rows.count(), time.monotonic() - began)
        self.spark.createDataFrame([told], self._SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return rows

    def view(self) -> DataFrame:
        """statement, calls, rows, seconds."""
        return self.spark.read.schema(self._SCHEMA).parquet(self.path).groupBy("statement").agg(*[F.sum(c).alias(c) for c in ("calls", "rows", "seconds")])

    def reset(self) -> None:
        """Forget all calls."""
        self.path = shared_folder(self.spark, "statistics")
        self.spark.createDataFrame([], self._SCHEMA).write.parquet(self.path)


def is_volatile(df: DataFrame, expression: str) -> bool:
    """True if an expression over df can differ from row to row or call to call with the same input (rand, uuid)."""
    return not df.selectExpr(expression)._jdf.queryExecution().analyzed().deterministic()


def explain(df: DataFrame, form: str = "text") -> str:
    """The plan as text (physical), as json (logical, optimized), or with analyze, after a run, with the rows of each operator."""
    execution = df._jdf.queryExecution()
    if form == "text":
        return execution.simpleString()
    if form == "json":
        return execution.optimizedPlan().toJSON()
    if form != "analyze":
        raise ValueError("form is text, json or analyze")
    execution.toRdd().count()
    lines, todo = [], [(execution.executedPlan(), 0)]
    while todo:
        node, depth = todo.pop()
        rows = node.metrics().get("numOutputRows")
        lines.append("  " * depth + node.nodeName() + (f" rows={rows.get().value()}" if rows.isDefined() else ""))
        below = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        todo += [(b, depth + 1) for b in reversed(below)]
    return "\n".join(lines)
