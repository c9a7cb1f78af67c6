"""Decision files: CSV with a header and eight text columns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DECISIONS


def read_decisions(spark: SparkSession, path: str | None) -> DataFrame:
    """The rows of a decision file with ``line``, which orders them as they stand in it; no file, no rows.

    Columns are found by the names in the header, others are left out and missing ones empty. A quoted value may hold line breaks,
    so the file is read from its beginning to its end by one task, row by row; a CRLF within a value is read as a line feed.
    """
    columns = DECISIONS.fieldNames()
    if path is None or not Path(path).exists():
        return spark.createDataFrame([], "line bigint, " + ", ".join(f"{c} string" for c in columns))
    rows = spark.read.csv(Path(path).resolve().as_uri(), header=True, multiLine=True, escape='"')
    return rows.select(F.monotonically_increasing_id().alias("line"), *(_text(rows, c) for c in columns))


def _text(rows: DataFrame, column: str) -> Column:
    found = F.coalesce(F.col(column).cast("string"), F.lit("")) if column in rows.columns else F.lit("")
    return found.alias(column)


def read_decision_folder(spark: SparkSession, path: str) -> DataFrame:
    """Decision files of any number and size, read by Spark; ``line`` orders rows within a file."""
    rows = spark.read.schema(DECISIONS).csv(path, header=True, multiLine=True, escape='"', nullValue="\x00", emptyValue="")
    return rows.select(F.monotonically_increasing_id().alias("line"), "*")
