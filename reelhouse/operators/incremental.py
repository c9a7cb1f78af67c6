"""What a scan finds against what the manifest knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import path_order
from .numbering import numbered

#: What a change to a file resets; all else of a known row stays.
_RESET = ("size", "mtime", "status", "content_hash", "phash")


def changed_files(walked: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of ``walked`` that aren't in the manifest with the same size and a modification time under a second apart.

    A path under several roots counts for the first of them (column ``root_position``, where there is one).
    """
    if "root_position" in walked.columns:
        first = Window.partitionBy("source_path").orderBy("root_position")
        walked = walked.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    known = manifest.select(F.col("source_path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = (F.col("source_path") == F.col("_path")) & (F.col("size") == F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) < 1)
    return walked.join(known, same, "left_anti")


def walk_key(files: DataFrame) -> Column:
    """The order of a walk: by root, where there are roots, then by the parts of the path."""
    position = [F.col("root_position")] if "root_position" in files.columns else []
    return F.struct(*position, path_order(F.col("source_path")).alias("parts"))


def upsert(manifest: DataFrame, changed: DataFrame) -> DataFrame:
    """The manifest with the changed files: a new snapshot.

    Known paths get the new size and modification time, lose their hashes and are scanned anew; new
    paths get ids after the largest one, root by root, in the order of the parts of their paths.
    """
    last = manifest.agg(F.max("id")).first()[0] or 0
    seen = changed.select("source_path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    touched = manifest.join(seen, "source_path", "left")
    hit = F.col("_mtime").isNotNull() | F.col("_size").isNotNull()
    new = {"size": F.col("_size"), "mtime": F.col("_mtime"), "status": F.lit("scanned"), "content_hash": F.lit(None), "phash": F.lit(None)}
    updated = touched.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in _RESET else F.col(c) for c in manifest.columns))
    added = numbered(changed.join(manifest.select("source_path"), "source_path", "left_anti"), walk_key(changed), "id", last)
    types = dict(manifest.dtypes)
    present = set(added.columns)
    columns = [
        F.lit("scanned").alias(c)
        if c == "status"
        else (F.col(c) if c in present else F.lit(None)).cast(types[c]).alias(c)
        for c in manifest.columns
    ]
    return updated.unionByName(added.select(*columns))


def scanned(manifest: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_id, action, detail): the log's rows of the files that a scan found changed, with the ids that they have now."""
    found = manifest.join(changed.select("source_path"), "source_path", "left_semi")
    return found.select(F.col("id").alias("file_id"), F.lit("scanned").alias("action"), F.col("source_path").alias("detail"))


def first_date(*tags: str):
    """The first of the tags that isn't null or empty."""
    return F.coalesce(*(F.nullif(F.col(t), F.lit("")) for t in tags))


def with_metadata(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """The manifest with the metadata that was read; rows without a record keep what they have.

    ``records``: source_path, DateTimeOriginal, CreateDate, MediaCreateDate, Model, ImageWidth, ImageHeight.
    """
    read = records.select(
        "source_path",
        F.lit(True).alias("_read"),
        first_date("DateTimeOriginal", "CreateDate", "MediaCreateDate").alias("_exif_date"),
        F.col("Model").alias("_camera"),
        F.col("ImageWidth").cast("int").alias("_width"),
        F.col("ImageHeight").cast("int").alias("_height"),
    )
    joined = manifest.join(read, "source_path", "left")
    tags = ("exif_date", "camera", "width", "height")
    return joined.select(*(F.when(F.col("_read"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in tags else F.col(c) for c in manifest.columns))
