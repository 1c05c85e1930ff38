"""COPY: text and CSV files in and out."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def copy_from(spark: SparkSession, path: str, schema, form: str = "csv", delimiter: str | None = None, header: bool = False, null: str | None = None, quote: str = '"', escape: str | None = None) -> DataFrame:
    """COPY t FROM path. csv: comma, null is the empty string unquoted; text: tab, null is \\N. A malformed row raises."""
    csv = form == "csv"
    r = spark.read.schema(schema).option("sep", delimiter or ("," if csv else "\t")).option("nullValue", null if null is not None else ("" if csv else "\\N"))
    r = r.option("header", header).option("mode", "FAILFAST").option("quote", quote if csv else "").option("escape", escape or quote)
    return r.option("emptyValue", "").option("multiLine", csv).csv(path)


def copy_to(df: DataFrame, path: str, form: str = "csv", delimiter: str | None = None, header: bool = False, null: str | None = None) -> None:
    """COPY t TO path: one file for each partition."""
    csv = form == "csv"
    w = df.write.option("sep", delimiter or ("," if csv else "\t")).option("nullValue", null if null is not None else ("" if csv else "\\N"))
    w.option("header", header).option("quote", '"' if csv else "").option("escape", '"').option("emptyValue", '""' if csv else "").csv(path)


def copy_from_lines(spark: SparkSession, lines: Iterable[str], schema: str, form: str = "csv", delimiter: str | None = None, null: str | None = None) -> DataFrame:
    """COPY t FROM STDIN: the lines that a client sends through the driver, one row each; a line \\. ends them. A malformed row raises."""
    csv, kept = form == "csv", []
    for line in lines:
        if line == "\\.":
            break
        kept.append((line,))
    options = {"sep": delimiter or ("," if csv else "\t"), "nullValue": null if null is not None else ("" if csv else "\\N"), "mode": "FAILFAST"}
    if not csv:
        options["quote"] = ""
    return spark.createDataFrame(kept, "line string").select(F.from_csv("line", schema, options).alias("r")).select("r.*")


def copy_from_program(spark: SparkSession, command: list[str], schema: str, form: str = "csv", delimiter: str | None = None, null: str | None = None) -> DataFrame:
    """COPY t FROM PROGRAM: the rows that a command on the driver prints. A command that fails raises."""
    told = subprocess.run(command, check=True, capture_output=True, text=True)
    return copy_from_lines(spark, told.stdout.splitlines(), schema, form, delimiter, null)
