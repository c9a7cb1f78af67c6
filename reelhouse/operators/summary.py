"""Counts over a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import companion_key


def status(manifest: DataFrame) -> DataFrame:
    """(facet, value, n): rows by status, by role and by the source of their date, in one pass over the rows."""
    facets = F.explode(
        F.array(
            *(
                F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c), F.lit("-")).alias("value"))
                for c in ("status", "role", "date_source")
            )
        )
    )
    return manifest.select(facets.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def plan_counts(planned: DataFrame) -> DataFrame:
    """Exact copies (files), pairs of raw and image, and bursts and review groups (groups)."""
    role = F.col("role")
    return planned.agg(
        F.count_if(role == "exact_dupe").alias("exact_dupes"),
        # Of a pair, a file with copies has the copies' group.
        F.count_distinct(F.when(role == "raw_jpeg_pair", companion_key())).alias("raw_pairs"),
        F.count_distinct(F.when(role == "burst", F.col("group_id"))).alias("bursts"),
        F.count_distinct(F.when(role == "review", F.col("group_id"))).alias("review_groups"),
    )


def plan_detail(counts: DataFrame) -> DataFrame:
    """(detail): the counts of a plan as the log has them."""
    return counts.select(F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in counts.columns)).alias("detail"))
