from __future__ import annotations

import csv
import hashlib
import os

from reelhouse.config import Config
from reelhouse.plans.library import Library


def test_scan_plan_review_apply(spark, tmp_path):
    src, out, work = tmp_path / "src", tmp_path / "out", tmp_path / "work"
    for name, content in {"Holiday 2015/a.jpg": "same", "x/copy.jpg": "same", "_MG_1.cr2": "raw", ".hidden.jpg": "h", "note.txt": "t"}.items():
        path = src / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    os.utime(src / "x/copy.jpg", (2e9, 2e9))
    library = Library(spark, str(work), Config(max_year=2040))
    rows = {r["rel_path"]: r for r in library.scan([str(src), str(tmp_path / "missing")]).collect()}
    assert sorted(rows) == ["Holiday 2015/a.jpg", "_MG_1.cr2", "x/copy.jpg"]
    assert rows["_MG_1.cr2"]["content_hash"] == hashlib.blake2b(b"raw", digest_size=20).hexdigest()
    planned = {r["rel_path"]: r for r in library.plan().collect()}
    assert planned["x/copy.jpg"]["role"] == "exact_dupe"
    assert library.review() is None
    assert library.routed(str(out)).where("action = 'copy'").count() == 2 and not out.exists()
    assert tuple(library.apply(str(out)).first()) == (2, 1, 0)
    copied = sorted(p.name for p in out.rglob("*") if p.is_file())
    assert len(copied) == 3 and any(n.endswith(".cr2.xmp") for n in copied)
    assert {tuple(r) for r in library.status().where("facet = 'status'").select("value", "n").collect()} == {("copied", 2), ("skipped_dupe", 1)}
    (src / "new.jpg").write_text("same")
    library.scan([str(src)])
    library.plan()
    assert tuple(library.apply(str(out)).first()) == (0, 2, 0)
    assert sorted(p.name for p in out.rglob("*") if p.is_file()) == copied
    assert library.store.actions().where("action = 'scanned'").count() == 4
    assert library.store.runs().count() == 6


def test_decisions_are_carried_forward(spark, tmp_path):
    from .test_review import QUEUE, manifest

    library = Library(spark, str(tmp_path), Config(max_year=2040))
    library.store.write_files(manifest(spark, *QUEUE))
    library.review()
    path = tmp_path / "decisions.csv"
    rows = list(csv.DictReader(path.open(newline="", encoding="utf-8")))
    assert [r["file_id"] for r in rows] == ["1", "2", "4"] and path.read_bytes().count(b"\r\n") == 4
    rows[1]["decision"] = "Skip"
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, rows[0].keys())
        out.writeheader()
        out.writerows(rows)
    library.review()
    assert [r["decision"] for r in csv.DictReader(path.open(newline="", encoding="utf-8"))] == ["", "Skip", ""]
    assert "</script>.jpg" not in (tmp_path / "review.html").read_text("utf-8")


def test_streams(spark, tmp_path):
    from datetime import datetime

    from reelhouse.streaming import arrivals

    rows = [("a", datetime(2024, 1, 1, 0, m), "image", 5) for m in (0, 1)] + [("b", datetime(2024, 1, 1, 0, 12), "image", 7)]
    spark.createDataFrame(rows, "content_hash string, arrived timestamp, kind string, size bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("content_hash string, arrived timestamp, kind string, size bigint").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.table(name)

    assert sorted(r["content_hash"] for r in run(arrivals.first_arrivals(stream), "first_seen", "append").collect()) == ["a", "b"]
    counted = run(arrivals.arrivals_by_window(stream), "by_window", "update")
    assert sorted(r["n"] for r in counted.collect()) == [1, 2]
    clicks = [(1, 1, 10, "keep", [10, 11]), (1, 2, 11, "donate", [10, 11])]
    kind = "group_id bigint, seq bigint, file_id bigint, action string, files array<bigint>"
    spark.createDataFrame(clicks, kind).write.parquet(str(tmp_path / "clicks"))
    followed = run(arrivals.follow_clicks(spark.readStream.schema(kind).parquet(str(tmp_path / "clicks"))), "followed", "update")
    assert {tuple(r) for r in followed.collect()} == {(1, 10, "keep", "11"), (1, 11, "skip", "")}
