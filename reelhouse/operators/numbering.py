"""Numbers in the order of a key, without gathering the rows, or a group of them, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import checkpoint


def by_ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` and written, with the number of their range in ``_range``.

    Ranges follow the order, and rows that are equal in it are in the same one.
    """
    return checkpoint(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def numbered(rows: DataFrame, key: str | Column, name: str, after: int = 0) -> DataFrame:
    """``rows`` with ``name``: after + 1, after + 2, ... by ``key``, whose values are distinct.

    Rows are dealt by ranges of the key and numbered within each; only the ranges' sizes, one
    number a partition, meet in one place.
    """
    key = F.col(key) if isinstance(key, str) else key
    dealt = by_ranges(rows, key)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return dealt.join(offsets, "_range").withColumn(name, F.col("_before") + within + F.lit(after).cast("long")).drop("_range", "_before")


def placed(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each ``group``, in the order of columns that tell its rows apart.

    As ``numbered``; a group that is larger than a range is numbered by several tasks, and only the number of its rows in
    each of its ranges meets in one place.
    """
    dealt = by_ranges(rows, F.col(group), *order)
    sizes = dealt.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_group", "_of", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    joined = dealt.withColumn("_within", within).join(offsets, (F.col(group).eqNullSafe(F.col("_group"))) & (F.col("_range") == F.col("_of")))
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_group", "_of", "_before", "_within")
