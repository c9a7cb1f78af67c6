"""The five commands over a library: scan, plan, review, apply and status."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load_config
from ..operators import incremental, outcome, summary
from ..operators import review as reviewing
from ..operators.state import checkpoint
from ..sinks import library as sinks
from ..sinks.tables import Store, now
from ..sources import decisions as decision_files
from ..sources import files as sources
from .plan import plan as make_plan


class Library:
    def __init__(self, spark: SparkSession, workdir: str, cfg: Config | None = None) -> None:
        self.spark, self.workdir = spark, str(Path(workdir).expanduser().resolve())
        Path(self.workdir).mkdir(parents=True, exist_ok=True)
        self.cfg = cfg or load_config(self.workdir)
        self.store = Store(spark, f"file://{self.workdir}/state")

    def _log(self, rows: DataFrame, run_id: int, command: str) -> None:
        self.store.log(rows.select(F.lit(run_id).cast("long").alias("run_id"), "*", F.lit(now()).alias("ts")), run_id, command)

    def _note(self, run_id: int, command: str, action: str, detail: str) -> None:
        self._log(self.spark.createDataFrame([(0, action, detail)], "file_id bigint, action string, detail string"), run_id, command)

    def scan(self, roots: list[str]) -> DataFrame:
        """Add new and changed files to the manifest with their fingerprints and metadata.

        What lacks a content hash is hashed, whatever scan found it, so an interrupted scan is made good by the next one.
        """
        run_id = self.store.new_run("scan", {"sources": roots})
        walked = sources.walk(self.spark, roots, self.cfg)
        changed = checkpoint(incremental.changed_files(walked, self.store.files()))
        manifest = self.store.write_files(incremental.upsert(self.store.files(), changed))
        pending = manifest.where("content_hash IS NULL AND status = 'scanned'").select("source_path")
        hashes = sources.content_hashes(pending).withColumnsRenamed({"source_path": "_path", "content_hash": "_hash", "error": "_error"})
        joined = manifest.join(hashes, manifest["source_path"] == hashes["_path"], "left")
        new = {
            "content_hash": F.coalesce("_hash", "content_hash"),
            "status": F.when(F.col("_error").isNotNull(), "error").otherwise(F.col("status")),
            "error": F.coalesce("_error", "error"),
        }
        hashed = joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in manifest.columns))
        if sources.exiftool_available():
            hashed = incremental.with_metadata(hashed, sources.metadata(changed, self.cfg))
        prints = sources.perceptual_hashes(sources.pending_images(manifest)).withColumnsRenamed({"source_path": "_p", "phash": "_phash"})
        printed = hashed.join(prints, hashed["source_path"] == prints["_p"], "left")
        printed = printed.select(*(F.coalesce("_phash", "phash").alias(c) if c == "phash" else F.col(c) for c in manifest.columns))
        manifest = self.store.write_files(printed)
        self._log(incremental.scanned(manifest, changed), run_id, "scan")
        return manifest

    def plan(self) -> DataFrame:
        run_id = self.store.new_run("plan", {})
        planned = self.store.write_files(make_plan(self.store.files(), self.cfg))
        self._note(run_id, "plan", "plan", summary.plan_detail(summary.plan_counts(planned)).first()[0])
        return planned

    def review(self) -> DataFrame | None:
        """Write the review page and the decision file, earlier decisions kept; None, and no file touched, if nothing waits."""
        queued = checkpoint(reviewing.queue(self.store.files()))
        if queued.isEmpty():
            return None
        run_id = self.store.new_run("review", {})
        path = f"{self.workdir}/decisions.csv"
        prior = reviewing.prior_decisions(decision_files.read_decisions(self.spark, path))
        rows = checkpoint(reviewing.decision_rows(queued, prior))
        sinks.write_decisions(rows, path)
        Path(self.workdir, "thumbs").mkdir(exist_ok=True)
        thumbs = sinks.make_thumbnails(queued, f"{self.workdir}/thumbs")
        sinks.write_review_page(reviewing.payload(queued, rows, thumbs), f"{self.workdir}/review.html", self.workdir)
        groups, files = reviewing.exported(rows).first()
        self._note(run_id, "review", "review_exported", f"{groups} groups, {files} files")
        return rows

    def routed(self, out: str, decisions: str | None = None) -> DataFrame:
        """What applying would do; this is the dry run, and changes nothing."""
        rows = decision_files.read_decisions(self.spark, decisions or f"{self.workdir}/decisions.csv")
        root = str(Path(out).expanduser().resolve())
        routed = outcome.route(self.store.files(), reviewing.accepted_decisions(rows))
        return outcome.with_destinations(routed, self.cfg, root)

    def apply(self, out: str, decisions: str | None = None) -> DataFrame:
        """Copy keepers into the library and record what was done; files that can't be copied stay as planned."""
        run_id = self.store.new_run("apply", {"out": out, "decisions": decisions})
        manifest = self.store.files()
        routed = checkpoint(self.routed(out, decisions))
        copied = checkpoint(sinks.copy_files(routed.where("action = 'copy'")))
        failed = copied.where("error IS NOT NULL").select("id")
        done = checkpoint(routed.join(failed, "id", "left_anti").select(*routed.columns))
        keepers = done.where("action = 'copy'")
        origins = checkpoint(outcome.origins(keepers, manifest))
        told = keepers.select("id", "dest_path", "ext").join(outcome.first_folders(origins), "id", "left")
        sinks.write_provenance(told, outcome.description_pieces(origins), self.cfg).count()
        self.store.write_files(outcome.applied(manifest, done))
        merged = sinks.merge_into_files(outcome.merge_jobs(done, manifest))
        notes = outcome.actions(done, run_id, now()).select("file_id", "action", "detail")
        merges = merged.select(
            F.col("keeper_id").alias("file_id"),
            F.lit("metadata_merged").alias("action"),
            F.concat(F.lit("from file "), F.col("donor_id").cast("string")).alias("detail"),
        )
        self._log(notes.unionByName(merges), run_id, "apply")
        return outcome.outcome_counts(done)

    def status(self) -> DataFrame:
        return summary.status(self.store.files()).orderBy("facet", "value")
