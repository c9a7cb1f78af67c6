"""Equal content, companion files, near-duplicates and bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates, text
from .components import hamming_components
from .numbering import by_ranges
from .state import checkpoint


def exact_groups(files: DataFrame) -> DataFrame:
    """``files`` with keeper_id and n_same for each content_hash.

    The keeper is a file that is copied already, else the one modified first (unknown: 0), else the
    one with the smallest id. An aggregation that combines before the shuffle finds it. Its result is written, so that the
    join back can be split, and content that a third of all files share isn't one task's work.
    """
    rank = F.struct((F.col("status") != "copied").alias("new"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"), F.col("id").alias("id"))
    best = files.groupBy("content_hash").agg(F.min(rank)["id"].alias("keeper_id"), F.count("*").alias("n_same"))
    return files.join(checkpoint(best), "content_hash")


def companion_key() -> Column:
    """Folder and stem in lower case."""
    path = F.col("source_path")
    return F.concat_ws("/", F.lower(text.parent(path)), F.lower(text.stem(path)))


def companions(keepers: DataFrame) -> DataFrame:
    """(id, pair_key, pair, image_exif) of files with a companion: raw and image, or image and video (live).

    Every kind with the same folder and stem belongs to the pair. ``image_exif`` is that of the first image by id.
    """
    own = keepers.select("id", "kind", "exif_date", companion_key().alias("pair_key"))

    def some(kind: str) -> Column:
        return F.bool_or(F.col("kind") == kind)

    first = F.min(F.when(F.col("kind") == "image", F.struct("id", "exif_date")))
    pairs = own.groupBy("pair_key").agg(some("raw").alias("r"), some("image").alias("i"), some("video").alias("v"), first.alias("f"))
    kind = F.when(F.col("r") & F.col("i"), "raw").when(F.col("v") & F.col("i"), "live")
    pairs = pairs.select("pair_key", kind.alias("pair"), F.col("f.exif_date").alias("image_exif")).where("pair IS NOT NULL")
    return own.select("id", "pair_key").join(pairs, "pair_key")


def similar_images(keepers: DataFrame, threshold: int) -> DataFrame:
    """(id, component) of images whose perceptual hashes are joined by links of at most ``threshold`` bits.

    Images with the same hash are one node; those without neighbours are their own component.
    """
    images = keepers.where("kind = 'image'").select("id", text.hash_bits(F.col("phash")).alias("node")).where("node IS NOT NULL")
    joined = hamming_components(images, threshold, "node")
    return images.join(joined, "node").select("id", "component")


def burst_or_review(members: DataFrame, cfg: Config) -> DataFrame:
    """(component, verdict) of components with two members or more (columns component, exif_date, camera).

    burst: every member has a date in its metadata, all have one and the same camera, and no gap
    between one and the next is over the window. Everything else is for review.
    """
    timed = members.select("component", "camera", dates.exif_date(F.col("exif_date"), cfg).alias("t"))
    whole = (F.count("t") == F.count("*")) & (F.count("camera") == F.count("*")) & (F.min("camera") == F.max("camera"))
    # Written, so that a large component's rows can be split where they are joined with what is known of it.
    checked = checkpoint(timed.groupBy("component").agg(F.count("*").alias("n"), whole.alias("whole")).where("n >= 2"))
    # Only components that can still be bursts are put in order.
    likely = timed.join(checked.where("whole").select("component"), "component", "left_semi").select("component", "t")
    gaps = widest_gaps(likely)
    verdict = F.when(F.col("gap") <= cfg.burst_window_s, "burst").otherwise("review")
    return checked.join(gaps, "component", "left").select("component", verdict.alias("verdict"))


def widest_gaps(timed: DataFrame) -> DataFrame:
    """(component, gap): the most seconds between one of a component's times (columns component, t) and the next.

    Rows are dealt by ranges of component and time, so a component of very many is several tasks' work. Gaps within a
    range are found there; those between ranges are found from the first and last time of each, one row a component and range.
    """
    dealt = by_ranges(timed, "component", "t")
    in_order = Window.partitionBy("_range", "component").orderBy("t")
    gap = F.timestamp_diff("SECOND", F.lag("t").over(in_order), F.col("t"))
    ends = dealt.withColumn("gap", gap).groupBy("component", "_range").agg(F.max("gap").alias("gap"), F.min("t").alias("first"), F.max("t").alias("last"))
    across = F.timestamp_diff("SECOND", F.lag("last").over(Window.partitionBy("component").orderBy("_range")), F.col("first"))
    return ends.select("component", F.greatest("gap", across).alias("gap")).groupBy("component").agg(F.max("gap").alias("gap"))
