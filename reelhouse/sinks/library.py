"""Files that a plan makes: decision files, review pages, thumbnails, copies, sidecars and embedded metadata.

What touches media files runs on executors, one partition of rows at a time, and reports rows. Each
step can be repeated: copies go to a name of their own and are renamed, and what exists stays.
"""

from __future__ import annotations

import html
import os
import shutil
import subprocess
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..operators import outcome, review
from ..operators.state import checkpoint, importable_on_workers
from ..schema import DECISIONS


def _parts(rows: DataFrame, folder: str, name: str, head: str, between: str, tail: str) -> DataFrame:
    """(part, file, first, last, rows): each partition of ``rows`` (key, line) as one file below ``folder``, written by its task.

    Lines come as the partition has them, with ``between`` them. ``first`` and ``last`` are keys. An empty partition has no
    file. A file gets its name when it is whole, so a task that runs twice does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, count, first, last = TaskContext.get().partitionId(), 0, None, None
        target = Path(folder, name.format(number))
        part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
        out = None
        for batch in batches:
            for key, line in zip(batch["key"], batch["line"]):
                if out is None:
                    target.parent.mkdir(parents=True, exist_ok=True)
                    out = open(part, "w", encoding="utf-8", newline="")
                    out.write(head)
                    first = int(key)
                out.write((between if count else "") + line)
                count, last = count + 1, int(key)
        if out is not None:
            out.write(tail)
            out.close()
            os.replace(part, target)
            yield pd.DataFrame({"part": [number], "file": [target.name], "first": [first], "last": [last], "rows": [count]})

    return rows.select("key", "line").mapInPandas(run, "part int, file string, first bigint, last bigint, rows bigint")


def _joined(parts: DataFrame, folder: str, path: str, head: str = "", tail: str = "") -> None:
    """One file of all parts in order, put together by one task that copies bytes and holds no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            out.write(head.encode())
            for batch in batches:
                for name in batch["file"]:
                    with open(Path(folder, name), "rb") as own:
                        shutil.copyfileobj(own, out, 1 << 20)
            out.write(tail.encode())
        os.replace(part, path)
        yield pd.DataFrame({"done": [1]})

    parts.repartition(1).sortWithinPartitions("part").select("file").mapInPandas(run, "done int").count()


def write_decisions(rows: DataFrame, path: str) -> DataFrame:
    """One CSV file with a header, RFC 4180 quoting and CRLF, by group and file; returns its index.

    Each range of groups and files is written as a part by its own task, beside the file, and the parts are joined. The
    index, (part, file, first, last, rows), also written as ``index.csv``, tells which groups each part holds; the parts stay, for
    who wants to read a range of a large file.
    """
    folder = f"{path}.parts"
    lines = review.csv_lines(rows.select(*DECISIONS.fieldNames()))
    lines = lines.repartitionByRange("group_id", "file_id").sortWithinPartitions("group_id", "file_id")
    shutil.rmtree(folder, ignore_errors=True)
    told = lines.select(F.col("group_id").cast("long").alias("key"), F.concat("line", F.lit("\r\n")).alias("line"))
    index = checkpoint(_parts(told, folder, "decisions-{:05}.csv", "", "", ""))
    entry = F.concat(F.concat_ws(",", "file", "first", "last", "rows"), F.lit("\r\n"))
    entries = index.repartition(1).sortWithinPartitions("part").select(F.col("first").alias("key"), entry.alias("line"))
    _parts(entries, folder, "index.csv", "file,first_group,last_group,rows\r\n", "", "").count()
    _joined(index, folder, path, ",".join(DECISIONS.fieldNames()) + "\r\n")
    return index


_PAGE = """<!doctype html>
<meta charset="utf-8">
<title>Review</title>
<script id="data" type="application/json">{"workdir": WORKDIR, "groups": [
GROUPS
]}</script>
<main></main>
<script>
const data = JSON.parse(document.getElementById("data").textContent);
for (const group of data.groups) {
  const section = document.createElement("section");
  const title = document.createElement("h2");
  title.textContent = `group ${group.gid}` + (group.page ? `, page ${group.page + 1}` : "") + `: ${group.files.length} files`;
  section.append(title);
  for (const file of group.files) {
    const figure = document.createElement("figure");
    if (file.thumb) figure.append(Object.assign(document.createElement("img"), {src: file.thumb}));
    const caption = document.createElement("figcaption");
    caption.textContent = [file.path, file.csv.resolution, `${file.csv.size_kb} KB`, file.csv.suggestion, file.decision].join(" | ");
    figure.append(caption);
    section.append(figure);
  }
  document.querySelector("main").append(section);
}
</script>
"""


_INDEX = """<!doctype html>
<meta charset="utf-8">
<title>Review</title>
<ul>
ITEMS</ul>
"""
#: Files on one page file, about.
ON_PAGE = 2000


def write_review_page(payload: DataFrame, path: str, workdir: str, on_page: int = ON_PAGE) -> DataFrame:
    """Pages with the groups' payload as JSON, which no path in it can end early; returns their index.

    Each range of groups, or of a large group's pages, is one file, written by its own task below ``review_pages``. ``path`` is
    a list of links to them with the groups on each; where one file holds all, it is that file.
    """
    folder = str(Path(path).with_name("review_pages"))
    shutil.rmtree(folder, ignore_errors=True)
    payload = checkpoint(payload)
    files = payload.agg(F.sum(F.size("files"))).first()[0] or 0
    ranges = max(1, -(-files // on_page))
    own = payload.sparkSession.range(1).select(text.script_safe(F.to_json(F.array(F.lit(workdir))))).first()[0][1:-1]
    head, tail = (x.replace("WORKDIR", own) for x in _PAGE.split("GROUPS"))
    lines = payload.repartitionByRange(ranges, "gid", "page").sortWithinPartitions("gid", "page")
    json = text.script_safe(F.to_json(F.struct("gid", "page", "files"), {"ignoreNullFields": "false"}))
    index = checkpoint(_parts(lines.select(F.col("gid").alias("key"), json.alias("line")), folder, "page-{:05}.html", head, ",\n", tail))
    if ranges == 1:
        _joined(index, folder, path)
        return index
    item = F.format_string('<li><a href="review_pages/%s">groups %d to %d</a></li>\n', "file", "first", "last")
    links = index.repartition(1).sortWithinPartitions("part").select(F.col("first").alias("key"), item.alias("line"))
    top, end = _INDEX.split("ITEMS")
    _parts(links, str(Path(path).parent), Path(path).name.replace("{", "{{").replace("}", "}}"), top, "", end).count()
    return index


def make_thumbnails(queued: DataFrame, folder: str, side: int = 320) -> DataFrame:
    """(id) of files with a thumbnail in ``folder``, made where there is none and the optional library can."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for number, source in zip(batch["id"], batch["source_path"]):
                target = Path(folder, f"{number}.jpg")
                if not target.exists():
                    try:
                        from PIL import Image

                        with Image.open(source) as image:
                            image.thumbnail((side, side))
                            image.convert("RGB").save(target, "JPEG", quality=80)
                    except Exception:  # no library, or a picture that can't be decoded: no thumbnail
                        pass
                if target.exists():
                    made.append(number)
            yield pd.DataFrame({"id": made}, dtype="int64")

    return queued.select("id", "source_path").mapInPandas(run, "id bigint")


def _copy(source: str, target: str) -> str | None:
    if os.path.exists(target):
        return None
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        shutil.copy2(source, part)  # with its modification time
        os.replace(part, target)
    except OSError as e:
        if os.path.exists(part):
            os.unlink(part)
        return str(e)
    return None


def copy_files(routed: DataFrame) -> DataFrame:
    """(id, error): copy source_path to dest_path where there is no file yet; the source is never changed."""
    importable_on_workers(routed.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = [_copy(s, d) for s, d in zip(batch["source_path"], batch["dest_path"])]
            yield pd.DataFrame({"id": batch["id"], "error": pd.Series(errors, dtype=object)})

    return routed.select("id", "source_path", "dest_path").mapInPandas(run, "id bigint, error string")


def write_provenance(copied: DataFrame, pieces: DataFrame, cfg: Config) -> DataFrame:
    """(id, way): a sidecar beside files of formats that nothing is embedded in; exiftool embeds in the others.

    ``copied``: id, dest_path, ext, keywords. ``pieces``: id, piece, line, in order the parts of a description. A file's
    pieces are read one after the other and passed on, to the sidecar or to the one exiftool of the partition, so no
    description is ever held as a whole.
    """
    importable_on_workers(copied.sparkSession)
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    head, middle, tail = outcome.SIDECAR
    files = copied.select(
        "id",
        "dest_path",
        outcome.way(F.col("ext"), cfg).alias("way"),
        outcome.sidecar_items(words).alias("items"),
        F.array_join(F.transform(words, lambda k: F.concat(F.lit("-XMP-dc:Subject="), k, F.lit("\n"))), "").alias("subjects"),
    )
    rows = files.join(pieces, "id", "left")
    line = F.coalesce("line", F.lit(""))
    rows = rows.withColumn("line", F.when(F.col("way") == "sidecar", text.escape_html(line)).otherwise(line))
    rows = rows.repartition("id").sortWithinPartitions("id", "piece").select("id", "dest_path", "way", "items", "subjects", "line")
    prefix = cfg.provenance_prefix
    escaped = html.escape(prefix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, tried, out, own = None, False, None, None

        def end() -> None:
            if own is None or out is None:
                return
            if own.way == "embedded":
                out.write(f"\n{own.subjects}{own.dest_path}\n-execute\n")
            else:
                out.write(middle + own.items + tail)
                out.close()
                os.replace(f"{own.dest_path}.xmp.part", f"{own.dest_path}.xmp")

        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if own is not None and row.id == own.id:
                    if out is not None:
                        out.write(" | " + row.line)
                    continue
                end()
                own, out = row, None
                if row.way == "sidecar":
                    out = open(f"{row.dest_path}.xmp.part", "w", encoding="utf-8", newline="")
                    out.write(head + escaped + row.line)
                else:
                    if not tried:
                        tool, tried = _exiftool(), True
                    if tool is not None:
                        out = tool.stdin
                        out.write(f"-overwrite_original\n-XMP-dc:Description={prefix}{row.line}")
                done.append((row.id, row.way))
            yield pd.DataFrame(done, columns=["id", "way"])
        end()
        if tool is not None:
            tool.stdin.close()
            tool.wait()

    return rows.mapInPandas(run, "id bigint, way string")


def _exiftool() -> subprocess.Popen | None:
    """An exiftool that reads arguments line by line; none where it isn't installed."""
    if shutil.which("exiftool") is None:
        return None
    command = ["exiftool", "-@", "-", "-charset", "filename=utf8"]
    return subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, text=True, encoding="utf-8")


def merge_into_files(jobs: DataFrame) -> DataFrame:
    """(keeper_id, donor_id): fill tags that the keeper's file lacks from the donor's; nothing is overwritten."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if shutil.which("exiftool") is not None:
                for donor, keeper in zip(batch["donor_path"], batch["keeper_dest"]):
                    command = ["exiftool", "-overwrite_original", "-wm", "cg", "-tagsfromfile", donor, "-all:all", keeper]
                    subprocess.run(command, capture_output=True)
            yield batch[["keeper_id", "donor_id"]]

    return jobs.select("keeper_id", "donor_id", "donor_path", "keeper_dest").mapInPandas(run, "keeper_id bigint, donor_id bigint")
