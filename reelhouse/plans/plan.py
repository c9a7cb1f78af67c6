"""A plan: what each file of a manifest is, which belong together, and when they were taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates
from ..operators.state import checkpoint
from ..operators.grouping import burst_or_review, companions, exact_groups, similar_images
from ..operators.numbering import numbered
from ..schema import DURABLE, FROZEN

_DERIVED = ("role", "group_id", "dupe_of")


def reset(manifest: DataFrame) -> DataFrame:
    """The manifest without what an earlier plan derived; statuses that last stay."""
    frozen, durable = F.col("status").isin(*FROZEN), F.col("status").isin(*DURABLE)
    types = dict(manifest.dtypes)
    columns = []
    for c in manifest.columns:
        if c in _DERIVED:
            columns.append(F.when(frozen, F.col(c)).cast(types[c]).alias(c))
        elif c == "status":
            columns.append(F.when(durable, F.col(c)).otherwise("scanned").alias(c))
        else:
            columns.append(F.col(c))
    return manifest.select(*columns)


def last_group(fresh: DataFrame) -> int:
    """The number after which a plan's groups are numbered: the largest that a manifest keeps when it is reset."""
    return fresh.agg(F.max("group_id")).first()[0] or 0


def plan(manifest: DataFrame, cfg: Config | None = None) -> DataFrame:
    """A new snapshot of ``manifest`` with roles, groups, dates and statuses; a pure function of both arguments.

    Scanned and copied files with a content hash take part; all others pass through. Near-duplicates
    are looked for among all keepers, companions included, which may so bridge two others; only then
    do companions leave the components. Group numbers differ between plans, membership doesn't.
    """
    cfg = cfg or Config()
    fresh = reset(manifest)
    takes_part = F.col("status").isin("scanned", "copied") & F.col("content_hash").isNotNull()
    seed = last_group(fresh)

    files = exact_groups(fresh.where(takes_part))
    kept = F.col("id") == F.col("keeper_id")
    files = files.withColumn("role", F.when(kept, "keep").otherwise("exact_dupe"))
    files = files.withColumn("dupe_of", F.when(~kept, F.col("keeper_id")))
    files = files.withColumn("_group", F.when(F.col("n_same") > 1, F.concat(F.lit("same/"), F.col("content_hash"))))
    files = checkpoint(files.drop("keeper_id", "n_same"))
    keepers = files.where("role = 'keep'")

    paired = checkpoint(companions(keepers))
    similar = similar_images(keepers, cfg.near_dupe_threshold).join(paired.select("id"), "id", "left_anti")
    members = similar.join(keepers.select("id", "exif_date", "camera"), "id")
    judged = members.select("id", "component").join(burst_or_review(members, cfg), "component")

    files = files.join(paired, "id", "left").join(judged, "id", "left")
    video = (F.col("pair") == "live") & (F.col("kind") == "video")
    role = (
        F.when(F.col("verdict").isNotNull(), F.col("verdict"))
        .when(F.col("pair") == "raw", "raw_jpeg_pair")
        .when(video, "live_pair")
        .otherwise(F.col("role"))
    )
    group = F.when(F.col("verdict").isNotNull(), F.concat(F.lit("like/"), F.col("component").cast("string")))
    group = group.otherwise(F.coalesce("_group", F.concat(F.lit("pair/"), F.col("pair_key"))))
    own = F.nullif(F.col("exif_date"), F.lit(""))
    exif = F.when(video & own.isNull(), F.col("image_exif")).otherwise(F.col("exif_date"))
    files = files.withColumn("role", role).withColumn("_group", group).withColumn("exif_date", exif)

    groups = numbered(files.select("_group").where("_group IS NOT NULL").distinct(), "_group", "_number", seed)
    files = files.join(groups, "_group", "left").withColumn("_date", dates.resolve(cfg))
    status = F.when(F.col("status") == "copied", "copied").when(F.col("role") == "review", "review").otherwise("planned")
    new = {"group_id": F.col("_number"), "status": status, "exif_date": F.col("exif_date")}
    new |= {c: F.col(f"_date.{c}") for c in ("date_taken", "date_source", "date_confidence")}
    types = dict(manifest.dtypes)
    planned = files.select(*(new.get(c, F.col(c)).cast(types[c]).alias(c) for c in manifest.columns))
    return planned.unionByName(fresh.where(~F.coalesce(takes_part, F.lit(False))))
