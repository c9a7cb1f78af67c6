"""The review queue, its decisions, and the clicks that make them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .numbering import placed
from .state import checkpoint


def _pixels() -> Column:
    return F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0).cast("long"))


def queue(manifest: DataFrame) -> DataFrame:
    """Every row for review, with what its group says about it.

    suggested: the one with the most pixels, then the largest, then the smallest id. best_res and
    best_size: has the group's maximum, if that is over 0; all that share it are flagged. A group's best is
    found by an aggregation that combines before the shuffle, so a group of any size is no one task's work.
    """
    rows = manifest.where("role = 'review'")
    size = F.coalesce("size", F.lit(0).cast("long"))
    first = F.min(F.struct(-_pixels(), -size, F.col("id"))).getField("id").alias("_first")
    best = rows.groupBy(F.col("group_id").alias("_of")).agg(first, F.max(_pixels()).alias("_pixels"), F.max(size).alias("_size"))
    joined = rows.join(checkpoint(best), F.col("group_id").eqNullSafe(F.col("_of")))
    return joined.select(
        *(rows[c] for c in rows.columns),
        (F.col("id") == F.col("_first")).alias("suggested"),
        ((_pixels() == F.col("_pixels")) & (F.col("_pixels") > 0)).alias("best_res"),
        ((size == F.col("_size")) & (F.col("_size") > 0)).alias("best_size"),
    )


def prior_decisions(rows: DataFrame) -> DataFrame:
    """(file_id, decision, merge_from_file_id) of decided rows as they are written; of several for a file, the last.

    ``rows`` has the decision columns and ``line``, the place in the file.
    """
    decided = rows.where(F.trim(F.coalesce("decision", F.lit(""))) != "")
    last = F.max(F.struct("line", "decision", "merge_from_file_id")).alias("r")
    return decided.groupBy("file_id").agg(last).select("file_id", "r.decision", "r.merge_from_file_id")


def accepted_decisions(rows: DataFrame) -> DataFrame:
    """(file_id, decision, merge_from) as numbers: keep and skip in either case; of several for a file, the last."""
    decision = F.lower(F.trim("decision"))
    donor = F.nullif(F.trim(F.coalesce("merge_from_file_id", F.lit(""))), F.lit("")).cast("long")
    taken = rows.where(decision.isin("keep", "skip"))
    taken = taken.select(F.col("file_id").cast("long").alias("file_id"), "line", decision.alias("decision"), donor.alias("merge_from"))
    last = F.max(F.struct("line", "decision", "merge_from")).alias("r")
    return taken.groupBy("file_id").agg(last).select("file_id", "r.decision", "r.merge_from")


def decision_rows(queued: DataFrame, prior: DataFrame) -> DataFrame:
    """The eight columns of the decision file, with decisions made before carried forward."""
    old = prior.select(F.col("file_id").alias("_id"), F.col("decision").alias("_decision"), F.col("merge_from_file_id").alias("_merge"))
    joined = queued.join(old, queued["id"].cast("string") == old["_id"], "left")
    return joined.select(
        "group_id",
        F.col("id").alias("file_id"),
        "source_path",
        text.resolution(F.col("width"), F.col("height")).alias("resolution"),
        text.kilobytes(F.col("size")).alias("size_kb"),
        F.when(F.col("suggested"), "keep").otherwise("keep?").alias("suggestion"),
        F.coalesce("_decision", F.lit("")).alias("decision"),
        F.coalesce("_merge", F.lit("")).alias("merge_from_file_id"),
    )


#: Files of a group that are shown on one page.
PAGE = 500


def payload(queued: DataFrame, decisions: DataFrame, thumbnails: DataFrame | None = None, size: int = PAGE) -> DataFrame:
    """(gid, page, files): what a review page shows of each group's files, largest first, ``size`` of them a row.

    Pages count from 0. Files are given their places by ranges, so a large group is several tasks' work and several rows.
    """
    d = decisions.select("file_id", "resolution", "size_kb", "suggestion", "decision", F.col("merge_from_file_id").alias("merge"))
    rows = queued.join(d, queued["id"] == d["file_id"])
    thumb = F.lit(None).cast("string")
    if thumbnails is not None:
        made = thumbnails.select(F.col("id").alias("_thumb")).distinct()
        rows = rows.join(made, rows["id"] == made["_thumb"], "left")
        thumb = F.when(F.col("_thumb").isNotNull(), F.concat(F.lit("thumbs/"), F.col("_thumb").cast("string"), F.lit(".jpg")))
    bytes_ = F.coalesce("size", F.lit(0).cast("long"))
    shown = F.struct(
        "id",
        F.col("source_path").alias("path"),
        text.file_uri(F.col("source_path")).alias("uri"),
        thumb.alias("thumb"),
        F.col("width").alias("w"),
        F.col("height").alias("h"),
        bytes_.alias("size"),
        "ext",
        "kind",
        "camera",
        F.col("date_taken").alias("date"),
        "suggested",
        F.col("best_res").alias("bestRes"),
        F.col("best_size").alias("bestSize"),
        F.struct("resolution", "size_kb", "suggestion").alias("csv"),
        "decision",
        F.coalesce("merge", F.lit("")).alias("merge"),
    )
    told = rows.select(F.col("group_id").alias("gid"), (-bytes_).alias("_less"), F.col("id").alias("_id"), shown.alias("_file"))
    told = placed(told, "gid", [F.col("_less"), F.col("_id")], "_place")
    page = F.floor((F.col("_place") - 1) / size).cast("long").alias("page")
    ordered = F.array_sort(F.collect_list(F.struct("_place", F.col("_file").alias("f"))))
    return told.groupBy("gid", page).agg(F.transform(ordered, lambda x: x["f"]).alias("files"))


def normal_decision(decision: Column) -> Column:
    d = F.lower(F.coalesce(decision, F.lit("")))
    return F.when(d.isin("keep", "skip"), d).otherwise("")


def overlay(base: DataFrame, unsaved: DataFrame) -> DataFrame:
    """(group_id, file_id, decision): decisions of ``base`` with those of ``unsaved`` (file_id, decision) over them."""
    over = unsaved.select(F.col("file_id").alias("_id"), normal_decision(F.col("decision")).alias("_over"))
    joined = base.join(over, base["file_id"] == over["_id"], "left")
    return joined.select("group_id", "file_id", F.coalesce("_over", normal_decision(F.col("decision"))).alias("decision"))


def click(decisions: dict[int, str], donor: int | None, file_id: int, action: str) -> int | None:
    """Apply one click to a group's ``decisions``, in place; returns the donor.

    keep: a kept file is let go, and becomes a skip while others are kept; with none kept, the
    whole group is open again and has no donor. Any other file is kept, and what isn't kept is
    skipped. donate: a skipped file becomes the donor, or no longer is it.
    """
    if file_id not in decisions:
        return donor
    if action == "donate":
        return donor if decisions[file_id] != "skip" else None if donor == file_id else file_id
    if action != "keep":
        return donor
    if decisions[file_id] == "keep":
        decisions[file_id] = "skip"
        if "keep" not in decisions.values():
            decisions.update(dict.fromkeys(decisions, ""))
            return None
        return donor
    decisions[file_id] = "keep"
    decisions.update({k: "skip" for k, d in decisions.items() if d != "keep"})
    return None if donor == file_id else donor


FOLDED = "group_id bigint, file_id bigint, decision string, merge_from_file_id string"


def merged_rows(group_id: int, decisions: dict[int, str], donor: int | None) -> list[tuple]:
    """Rows of ``FOLDED``: kept files name the donor if it is a skipped file of the group."""
    valid = donor is not None and decisions.get(donor) == "skip"
    return [(group_id, k, d, str(donor) if valid and d == "keep" else "") for k, d in decisions.items()]


def fold_clicks(decisions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Decisions after all clicks (group_id, seq, file_id, action), each group's in the order of seq.

    ``decisions``: group_id, file_id, decision, merge_from_file_id. The same as ``click`` one by one, from three things:

    * A file is kept or not by its own clicks alone: each ``keep`` turns it round.
    * What isn't kept is as it was decided, with files that were let go skipped, until a file is kept: then it is skipped.
      When none is kept any longer, it is open.
    * The donor changes by the clicks in order.

    The first is a window over one file's clicks. The other two are an ``aggregate`` over the group's clicks in order, whose
    state is the number of kept files, what the others are, and the donor; it never holds the files. Files learn of their
    group by a join.
    """
    own = F.lower(F.coalesce("decision", F.lit("")))
    files = decisions.select("group_id", "file_id", F.when(own.isin("keep", "skip"), own).otherwise("").alias("own"), "merge_from_file_id")
    donor = F.when((F.col("own") == "keep") & (F.col("merge_from_file_id") != ""), F.struct("file_id", F.col("merge_from_file_id").cast("long").alias("of")))
    starts = files.groupBy("group_id").agg(F.count_if(F.col("own") == "keep").alias("kept"), F.max(donor)["of"].alias("donor"))

    done = clicks.where(F.col("action").isin("keep", "donate")).select("group_id", "seq", "file_id", (F.col("action") == "donate").alias("donate"))
    done = done.join(files.select("group_id", "file_id", "own"), ["group_id", "file_id"])
    earlier = Window.partitionBy("group_id", "file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum(F.when(F.col("donate"), 0).otherwise(1)).over(earlier), F.lit(0)) % 2 == 1
    done = checkpoint(done.select("group_id", "seq", "file_id", "donate", "own", ((F.col("own") == "keep") != turned).alias("kept")))

    entry = F.struct("seq", "file_id", "donate", "kept", F.col("own").isin("keep", "skip").alias("decided"))
    logs = done.groupBy("group_id").agg(F.array_sort(F.collect_list(entry)).alias("log"))
    # rest: what files that aren't kept are; null while it is as it was decided.
    first = F.struct(F.col("kept").alias("kept"), F.lit(None).cast("string").alias("rest"), F.col("donor").alias("donor"))

    def step(state: Column, c: Column) -> Column:
        skipped = ~c["kept"] & F.when(state["rest"].isNull(), c["decided"]).otherwise(state["rest"] == "skip")
        other = F.when(~skipped, state["donor"]).when(state["donor"].eqNullSafe(c["file_id"]), None).otherwise(c["file_id"])
        none = c["kept"] & (state["kept"] == 1)
        kept = F.when(c["donate"], state["kept"]).when(c["kept"], state["kept"] - 1).otherwise(state["kept"] + 1)
        rest = F.when(c["donate"], state["rest"]).when(none, "").when(c["kept"], state["rest"]).otherwise("skip")
        donor = F.when(c["donate"], other).when(none, None).when(c["kept"] | ~state["donor"].eqNullSafe(c["file_id"]), state["donor"])
        return F.struct(kept.alias("kept"), rest.alias("rest"), donor.alias("donor"))

    ended = starts.join(logs, "group_id").select("group_id", F.aggregate("log", first, step).alias("end"))
    ended = starts.join(ended, "group_id", "left").select(
        "group_id", F.col("end.rest").alias("rest"), F.when(F.col("end").isNull(), F.col("donor")).otherwise(F.col("end.donor")).alias("donor")
    )
    turns = done.where(~F.col("donate")).groupBy("group_id", "file_id").agg((F.count("*") % 2 == 1).alias("turned"))
    rows = files.join(turns, ["group_id", "file_id"], "left").join(checkpoint(ended), "group_id")
    kept = (F.col("own") == "keep") != F.coalesce("turned", F.lit(False))
    as_was = F.when(F.col("own") == "", "").otherwise("skip")
    rows = rows.select("group_id", "file_id", F.when(kept, "keep").otherwise(F.coalesce("rest", as_was)).alias("decision"), "donor")
    # A donor counts if it is a skipped file of the group.
    valid = rows.where("file_id = donor AND decision = 'skip'").select("group_id", F.col("donor").cast("string").alias("valid"))
    rows = rows.join(valid, "group_id", "left")
    merge = F.when(F.col("decision") == "keep", F.coalesce("valid", F.lit(""))).otherwise("")
    return rows.select("group_id", "file_id", "decision", merge.alias("merge_from_file_id"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """(group_id, file_id, line): each decision row as one line of the decision file."""
    columns = ("group_id", "file_id", "source_path", "resolution", "size_kb", "suggestion", "decision", "merge_from_file_id")
    return rows.select("group_id", "file_id", F.concat_ws(",", *(text.csv_field(F.col(c)) for c in columns)).alias("line"))


def progress(rows: DataFrame) -> DataFrame:
    """(decided, total): groups with a decision, and all groups."""
    groups = rows.groupBy("group_id").agg(F.bool_or(F.coalesce("decision", F.lit("")) != "").alias("any"))
    return groups.agg(F.count_if("any").alias("decided"), F.count("*").alias("total"))


def exported(rows: DataFrame) -> DataFrame:
    """(groups, files) of the decision rows that a review writes."""
    return rows.agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("files"))
