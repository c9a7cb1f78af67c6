"""Media files: listing trees, fingerprints of contents, and metadata.

All that lists folders or opens files runs on executors, in partitions of folders or paths, and returns rows. Paths must be readable there (a shared file system).
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import subprocess
from collections import deque
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import phash, text
from ..operators.state import checkpoint, importable_on_workers

WALKED = "source_path string, source_root string, rel_path string, size bigint, mtime double, root_position int"
HASHED = "source_path string, content_hash string, error string"
#: The tags that are read.
TAGS = ("DateTimeOriginal", "CreateDate", "MediaCreateDate", "Model", "ImageWidth", "ImageHeight")
RECORD = "source_path string, " + ", ".join(f"{t} string" for t in TAGS)
_CHUNK = 1 << 20
_ROWS = 50_000


#: Entries that a task lists before the folders that it hasn't come to are dealt out again.
_STEP = 20_000
_LISTED = WALKED + ", folder string, task int"


def _listing(step: int):
    """Files of the folders of a partition and below them, until ``step`` entries are listed; then the folders that are left.

    Names that begin with a dot are skipped, folders of such names aren't, and links to folders aren't followed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), 0
        columns = [c.split()[0] for c in _LISTED.split(", ")]
        rows: list[tuple] = []
        for frame in frames:
            for job in frame.itertuples(index=False):
                left = deque([job.folder])
                while left:
                    folder = left.popleft()
                    if seen >= step:
                        rows.append((folder, job.root, None, None, None, job.position, folder, task))
                    else:
                        try:
                            entries = list(os.scandir(folder))
                        except OSError:  # gone, or not to be read
                            entries = []
                        seen += len(entries) + 1
                        for e in entries:
                            if e.is_dir(follow_symlinks=False):
                                left.append(e.path)
                            elif not e.name.startswith(".") and e.is_file():
                                st = e.stat()
                                rows.append((e.path, job.root, os.path.relpath(e.path, job.root), st.st_size, st.st_mtime, job.position, None, task))
                    if len(rows) >= _ROWS:
                        yield _frame(rows, columns)
                        rows = []
        if rows:
            yield _frame(rows, columns)

    return run


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"size": "Int64", "mtime": "float64"})


def listed(spark: SparkSession, roots: list[tuple[str, int]], step: int = _STEP) -> DataFrame:
    """Rows of ``WALKED`` for every file below the roots (path, position), with the ``task`` that found it.

    Folders are the frontier of a search by rounds. In each, they are dealt to tasks; a task lists what is below its
    folders until it has seen ``step`` entries, and the folders that it hasn't come to are the next round's. So a deep or
    large folder is soon many tasks' work, and a small tree takes one round. Every round is written.
    """
    importable_on_workers(spark)
    found = []
    frontier = spark.createDataFrame([(root, position, root) for root, position in roots], "root string, position int, folder string")
    most = 4 * spark.sparkContext.defaultParallelism
    while n := frontier.count():
        round_ = checkpoint(frontier.repartition(min(n, most)).mapInPandas(_listing(step), _LISTED))
        found.append(round_.where("folder IS NULL").drop("folder"))
        left = round_.where("folder IS NOT NULL")
        frontier = left.select(F.col("source_root").alias("root"), F.col("root_position").alias("position"), "folder")
    return reduce(DataFrame.unionByName, found)


def walk(spark: SparkSession, roots: list[str], cfg: Config) -> DataFrame:
    """Media files below the roots that exist, with ``ext`` and ``kind``; files of other kinds are left out."""
    known = [(str(root), position) for position, root in enumerate(Path(r).expanduser().resolve() for r in roots) if root.exists()]
    if not known:
        return classified(spark.createDataFrame([], WALKED), cfg)
    return classified(listed(spark, known).drop("task"), cfg)


def path_order(path: Column) -> Column:
    """What paths are sorted by: their parts, one by one, so that a folder's files come before those of a folder whose name goes on."""
    return F.split(path, "/")


def classified(files: DataFrame, cfg: Config) -> DataFrame:
    """``files`` with ``ext`` and ``kind`` from source_path, without hidden names and other kinds."""
    named = files.withColumn("ext", text.suffix(F.col("source_path")))
    named = named.withColumn("kind", text.classify(F.col("ext"), cfg))
    return named.where((F.col("kind") != "other") & ~text.name(F.col("source_path")).startswith("."))


def blake2b(path: str) -> str:
    """The 160-bit BLAKE2b of a file's content in hex, read in pieces."""
    digest = hashlib.blake2b(digest_size=20)
    with open(path, "rb") as f:
        while piece := f.read(_CHUNK):
            digest.update(piece)
    return digest.hexdigest()


def content_hashes(paths: DataFrame) -> DataFrame:
    """(source_path, content_hash, error): a file that can't be read has an error instead of a hash."""
    importable_on_workers(paths.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["source_path"]:
                try:
                    rows.append((path, blake2b(path), None))
                except OSError as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["source_path", "content_hash", "error"])

    return paths.select("source_path").mapInPandas(run, HASHED)


def blake2b_column(column: str = "text"):
    """The 160-bit BLAKE2b of a string or binary column in hex; null stays null."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        raw = (None if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in values)
        return pd.Series([None if v is None else hashlib.blake2b(v, digest_size=20).hexdigest() for v in raw], dtype=object)

    return digest(F.col(column))


def grey_values(path: str) -> np.ndarray | None:
    """A picture's grey values, ``phash.SIDE`` rows and columns; null where it or the optional library can't be read."""
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        import pillow_heif

        pillow_heif.register_heif_opener()
    except ImportError:
        pass
    try:
        with Image.open(path) as image:
            return np.asarray(image.convert("L").resize((phash.SIDE, phash.SIDE), Image.Resampling.LANCZOS))
    except Exception:  # a picture that can't be decoded has no hash, whatever its decoder raises
        return None


def perceptual_hash(path: str) -> str | None:
    """The 64-bit perceptual hash in hex; null where there are no grey values."""
    grey = grey_values(path)
    return None if grey is None else phash.hex_hashes(grey[None])[0]


def pending_images(manifest: DataFrame) -> DataFrame:
    """Scanned images without a perceptual hash, from this scan or an earlier one."""
    return manifest.where("kind = 'image' AND phash IS NULL AND status = 'scanned'")


def perceptual_hashes(paths: DataFrame) -> DataFrame:
    """(source_path, phash), null where there is none."""
    importable_on_workers(paths.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"source_path": batch["source_path"], "phash": [perceptual_hash(p) for p in batch["source_path"]]})

    return paths.select("source_path").mapInPandas(run, "source_path string, phash string")


def exiftool_available() -> bool:
    return shutil.which("exiftool") is not None


def _records(paths: list[str]) -> list[dict]:
    arguments = ["-j", "-n", "-fast2", "-charset", "filename=utf8", *(f"-{t}" for t in TAGS), *paths]
    done = subprocess.run(["exiftool", "-@", "-"], input="\n".join(arguments) + "\n", capture_output=True, text=True, errors="replace")
    return json.loads(done.stdout) if done.stdout.strip() else []


def metadata(paths: DataFrame, cfg: Config) -> DataFrame:
    """Tags of each file that exiftool can read, in batches of ``cfg.exiftool_batch`` a process.

    A batch that fails, or a missing exiftool, gives no rows: its files keep what the manifest has.
    """
    importable_on_workers(paths.sparkSession)
    size = cfg.exiftool_batch

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), size):
                try:
                    found = _records(batch["source_path"].iloc[k : k + size].tolist())
                except (OSError, ValueError):
                    continue
                rows = [[str(Path(r.get("SourceFile", ""))), *(None if r.get(t) is None else str(r[t]) for t in TAGS)] for r in found]
                yield pd.DataFrame(rows, columns=["source_path", *TAGS])

    return paths.select("source_path").mapInPandas(run, RECORD)
