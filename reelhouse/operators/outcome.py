"""What applying a plan does to each file, and what it says about where files came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from .numbering import placed
from .state import checkpoint


def route(manifest: DataFrame, decisions: DataFrame) -> DataFrame:
    """Planned and queued rows with ``action`` and ``merge_from``.

    skip_dupe: an exact copy. held: for review and not decided. skip_manual: for review, decided skip. copy: the rest.
    """
    d = decisions.select(F.col("file_id").alias("_id"), F.col("decision").alias("_decision"), F.col("merge_from").alias("_donor"))
    rows = manifest.where(F.col("status").isin("planned", "review")).join(d, F.col("id") == F.col("_id"), "left")
    review = F.col("role").eqNullSafe("review")
    action = (
        F.when(F.col("role").eqNullSafe("exact_dupe"), "skip_dupe")
        .when(review & F.col("_decision").isNull(), "held")
        .when(review & (F.col("_decision") == "skip"), "skip_manual")
        .otherwise("copy")
    )
    donor = F.when((action == "copy") & review, F.nullif(F.col("_donor"), F.lit(0).cast("long")))
    return rows.select(*manifest.columns, action.alias("action"), donor.alias("merge_from"))


def with_destinations(routed: DataFrame, cfg: Config, root: str) -> DataFrame:
    """``routed`` with the place below ``root`` of what is to be copied; this is all that a dry run shows."""
    place = F.when(F.col("action") == "copy", text.destination(cfg, root)).otherwise(F.col("dest_path"))
    return routed.withColumn("dest_path", place)


def way(ext: Column, cfg: Config) -> Column:
    """How provenance goes with a file: embedded where its format takes it, else in a sidecar file."""
    return F.when(ext.isin(sorted(cfg.embed_ext)), "embedded").otherwise("sidecar")


def outcome_counts(routed: DataFrame) -> DataFrame:
    a = F.col("action")
    return routed.agg(
        F.count_if(a == "copy").alias("copied"), F.count_if(a.startswith("skip")).alias("skipped"), F.count_if(a == "held").alias("held")
    )


#: Folder names that are a file's keywords, at most.
KEYWORDS = 12
#: Parts into which a keeper's folder names are dealt to find the first ones, and paths of a piece of its description.
_PARTS, PIECE = 64, 1000


def origins(keepers: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, nth, rel) of each keeper itself (nth -1) and of its copies (nth: their ids)."""
    rel = F.coalesce("rel_path", F.lit(""))
    own = keepers.select("id", F.lit(-1).cast("long").alias("nth"), rel.alias("rel"))
    copies = manifest.where("dupe_of IS NOT NULL").select(F.col("dupe_of").alias("id"), F.col("id").alias("nth"), rel.alias("rel"))
    return own.unionByName(copies.join(keepers.select("id"), "id", "left_semi"))


def first_folders(origins: DataFrame, most: int = KEYWORDS) -> DataFrame:
    """(id, keywords): the first ``most`` distinct folder names of each id, in code-point order.

    Names are made distinct before and after a shuffle. The first ones of each part of an id's names are found, and of those
    the first ones; so the row that an id gathers has a bounded number of names, however many it has.
    """
    words = origins.select("id", F.explode(text.folders(F.col("rel"))).alias("word")).distinct()
    words = words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(_PARTS)))
    nth = F.row_number().over(Window.partitionBy("id", "part").orderBy("word"))
    some = words.withColumn("nth", nth).where(F.col("nth") <= most)
    return some.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("word")), 1, most).alias("keywords"))


def description_pieces(origins: DataFrame, size: int = PIECE) -> DataFrame:
    """(id, piece, line): the paths of each id, its own first, then its copies' by id, up to ``size`` in a line.

    Paths are numbered by ranges of id and place, so no row and no task has to hold all of a keeper's.
    """
    told = placed(origins.where("rel <> ''"), "id", [F.col("nth")], "place")
    told = told.withColumn("piece", F.floor((F.col("place") - 1) / size).cast("long"))
    pieces = told.groupBy("id", "piece").agg(F.array_sort(F.collect_list(F.struct("place", "rel"))).alias("rels"))
    return pieces.select("id", "piece", F.array_join(F.transform("rels", lambda r: r["rel"]), " | ").alias("line"))


def provenance(keepers: DataFrame, manifest: DataFrame, cfg: Config, most: int = KEYWORDS) -> DataFrame:
    """(id, keywords, description) of each keeper: folders of it and of its copies, and where they lay.

    Keywords are the distinct folder names in code-point order, the first ``most`` of them. Copies come by id. Here the
    description is one text, put together from pieces; what writes it to files takes the pieces.
    """
    found = checkpoint(origins(keepers, manifest))
    pieces = description_pieces(found).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", "line"))).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda p: p["line"]), " | ")
    rows = keepers.select("id").join(first_folders(found, most), "id", "left").join(pieces, "id", "left")
    return rows.select(
        "id",
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.concat(F.lit(cfg.provenance_prefix), F.coalesce(joined, F.lit(""))).alias("description"),
    )


def merge_jobs(routed: DataFrame, manifest: DataFrame) -> DataFrame:
    """(keeper_id, donor_id, donor_path, keeper_dest): whose missing metadata is filled from which file."""
    donors = manifest.select(F.col("id").alias("donor_id"), F.col("source_path").alias("donor_path"))
    jobs = routed.where("action = 'copy' AND merge_from IS NOT NULL")
    jobs = jobs.select(F.col("id").alias("keeper_id"), F.col("merge_from").alias("donor_id"), F.col("dest_path").alias("keeper_dest"))
    return jobs.where("keeper_dest IS NOT NULL").join(donors, "donor_id").select("keeper_id", "donor_id", "donor_path", "keeper_dest")


def fill_metadata(manifest: DataFrame, jobs: DataFrame, tags: tuple[str, ...] = ("exif_date", "camera", "width", "height")) -> DataFrame:
    """(keeper_id, tags...): the keeper's tags, and the donor's where the keeper has none. Nothing is overwritten."""
    k = manifest.select(F.col("id").alias("keeper_id"), *(F.col(t).alias(f"_k_{t}") for t in tags))
    d = manifest.select(F.col("id").alias("donor_id"), *(F.col(t).alias(f"_d_{t}") for t in tags))
    both = jobs.select("keeper_id", "donor_id").join(k, "keeper_id").join(d, "donor_id")
    return both.select("keeper_id", *(F.coalesce(f"_k_{t}", f"_d_{t}").alias(t) for t in tags))


def actions(routed: DataFrame, run_id: int, ts: str) -> DataFrame:
    """Rows of the action log for all that was done; held files aren't logged."""
    a = F.col("action")
    named = F.when(a == "skip_dupe", "skipped_exact_dupe").when(a == "skip_manual", "skipped_manual_review").otherwise("copied")
    copied = F.format_string(
        "%s -> %s (date:%s/%s, role:%s)", "source_path", "dest_path", "date_source", "date_confidence", "role"
    )
    detail = F.when(a == "skip_dupe", F.concat(F.lit("dupe_of="), F.col("dupe_of").cast("string"))).when(a == "copy", copied).otherwise("")
    rows = routed.where("action <> 'held'")
    return rows.select(F.lit(run_id).cast("long").alias("run_id"), F.col("id").alias("file_id"), named.alias("action"), detail.alias("detail"), F.lit(ts).alias("ts"))


def log_lines(actions: DataFrame) -> DataFrame:
    """The fields of the log's JSON lines, in their order."""
    return actions.select("ts", F.col("run_id").alias("run"), "file_id", "action", "detail")


def applied(manifest: DataFrame, routed: DataFrame) -> DataFrame:
    """The manifest after a plan was applied: new statuses, and the places of copied files."""
    status = F.when(F.col("action") == "copy", "copied").when(F.col("action") == "skip_dupe", "skipped_dupe")
    status = status.when(F.col("action") == "skip_manual", "skipped_manual")
    done = routed.select(F.col("id").alias("_id"), status.alias("_status"), F.when(F.col("action") == "copy", F.col("dest_path")).alias("_dest"))
    joined = manifest.join(done, manifest["id"] == done["_id"], "left")
    new = {"status": F.coalesce("_status", "status"), "dest_path": F.coalesce("_dest", "dest_path")}
    return joined.select(*(new[c].alias(c) if c in new else manifest[c] for c in manifest.columns))


#: The packet markers and namespaces of a sidecar file, around its description and its keywords.
SIDECAR = (
    '<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n'
    ' <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
    '  <rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/">\n'
    '   <dc:description><rdf:Alt><rdf:li xml:lang="x-default">',
    "</rdf:li></rdf:Alt></dc:description>\n   <dc:subject><rdf:Bag>",
    '</rdf:Bag></dc:subject>\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>',
)


def sidecar_items(keywords: Column) -> Column:
    return F.array_join(F.transform(keywords, lambda k: F.concat(F.lit("<rdf:li>"), text.escape_html(k), F.lit("</rdf:li>"))), "")


def sidecar(description, keywords):
    """The text of an XMP sidecar file with a description and keywords, as a column."""
    head, middle, tail = map(F.lit, SIDECAR)
    return F.concat(head, text.escape_html(description), middle, sidecar_items(keywords), tail)


def embed_arguments(dest, description, keywords):
    """The lines that tell exiftool to embed a description and keywords in one file, as an array column."""
    subjects = F.transform(keywords, lambda k: F.concat(F.lit("-XMP-dc:Subject="), k))
    first = F.array(F.lit("-overwrite_original"), F.concat(F.lit("-XMP-dc:Description="), description))
    return F.concat(first, subjects, F.array(dest, F.lit("-execute")))
