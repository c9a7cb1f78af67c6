"""Groups, folders and files that are too large for one task, against slow versions."""

from __future__ import annotations

import csv
import json
import math
import os
import random
import re
import stat
import statistics
import threading
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelhouse.config import Config
from reelhouse.functions import phash
from reelhouse.operators import components, grouping, metric, numbering, outcome, review
from reelhouse.sinks import library as sinks
from reelhouse.sinks.tables import Store
from reelhouse.sources import decisions as decision_files
from reelhouse.sources import files as sources

from .test_plan import manifest



@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Hamming links by a metric tree


def noisy(rng, center, bits, n):
    out = np.full(n, center, np.uint64)
    for _ in range(bits):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return out


def slow_links(hashes, radius):
    h = np.unique(hashes.view(np.int64))
    u, out = h.view(np.uint64), set()
    for i in range(len(u)):
        d = np.bitwise_count(u[i] ^ u[i + 1 :])
        out |= {(int(h[i]), int(h[i + 1 + j]), int(d[j])) for j in np.flatnonzero(d <= radius)}
    return out


def cluster(n):
    rng = np.random.default_rng(1)
    return np.concatenate([noisy(rng, c, 4, n) for c in rng.integers(0, 1 << 63, 30).astype(np.uint64)])


CASES = {
    "clusters": (cluster(40), 12, {}),
    "clusters, small leaves": (cluster(40), 12, {"leaf": 100, "visitors": 50}),
    "random": (np.random.default_rng(2).integers(0, 1 << 63, 700).astype(np.uint64), 20, {"leaf": 150, "visitors": 200}),
    "dense": (noisy(np.random.default_rng(3), np.uint64(1 << 63), 3, 700), 9, {"leaf": 64, "visitors": 64}),
    "few": (np.array([0, 1, 3, 0xFFFFFFFFFFFFFFFF], np.uint64), 64, {"leaf": 1, "visitors": 1}),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_metric_tree_finds_every_link_once(spark, case):
    hashes, radius, sizes = CASES[case]
    df = spark.createDataFrame([(int(h),) for h in [*hashes.view(np.int64), hashes.view(np.int64)[0]]] + [(None,)], "h bigint")
    rows = [tuple(r) for r in metric.searched(df, radius, **sizes).collect()]
    found = [r[:3] for r in rows if r[0] is not None]
    assert len(set(found)) == len(found) and set(found) == slow_links(hashes, radius)
    compared = sum(r[3] for r in rows if r[0] is None)
    if case.startswith("clusters"):
        assert compared < 0.7 * len(np.unique(hashes)) ** 2 / 2


@pytest.mark.parametrize("sizes", [{}, {"leaf": 60, "visitors": 70}])
def test_forests_join_what_links_join(spark, sizes):
    hashes, radius = np.concatenate([cluster(20), noisy(np.random.default_rng(3), np.uint64(5), 6, 150)]), 14
    df = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "h bigint")
    links = slow_links(hashes, radius)
    rows = metric.searched(df, radius, forest=True, **sizes).where("a IS NOT NULL")
    found = {tuple(r)[:3] for r in rows.collect()}
    assert found <= links and len(found) < len(links) / 2
    root = {int(h): int(h) for h in hashes.view(np.int64)}
    for _ in root:
        before = dict(root)
        for a, b, _ in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    nodes = df.withColumnRenamed("h", "node")
    assert {tuple(r) for r in components.components(rows, nodes).collect()} == set(root.items())
    if not sizes:
        assert {tuple(r) for r in components.hamming_components(df, radius).collect()} == set(root.items())


def test_links_at_every_radius_are_alike(spark):
    hashes = cluster(8)
    df = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "h bigint")
    for radius in (0, 1, 5, 8, 9, 16):
        assert {tuple(r) for r in components.hamming_links(df, radius).collect()} == slow_links(hashes, radius)
    assert components.hamming_links(df.limit(0), 16).count() == 0


def test_tree_parts_far_clusters_without_comparing_them():
    found: list = []
    hashes = np.unique(cluster(60))
    assert metric._among(hashes, 8, found) < 0.2 * len(hashes) ** 2 / 2
    assert sum(len(f[0]) for f in found) == len(slow_links(hashes, 8))


# Numbers, gaps and pieces by ranges


def test_places_within_groups(spark, many_ranges):
    rng = random.Random(1)
    rows = [(g, v) for g in (None, 1, 2) for v in rng.sample(range(10_000), 5 if g == 2 else 400)]
    got = numbering.placed(spark.createDataFrame(rows, "g bigint, v bigint"), "g", [F.col("v").desc()], "n").collect()
    want = {(g, v): 1 + sum(1 for h, w in rows if h == g and w > v) for g, v in rows}
    assert {(r["g"], r["v"]): r["n"] for r in got} == want and len(got) == len(rows)


def test_gaps_of_a_large_component(spark, many_ranges):
    rng, start = random.Random(2), datetime(2020, 1, 1)
    rows = [(1, start + timedelta(seconds=s)) for s in rng.sample(range(100_000), 3000)]
    rows += [(2, start), (3, start), (3, start), (4, start), (4, start + timedelta(seconds=7))]
    timed = spark.createDataFrame(rows, "component bigint, t timestamp_ntz")
    got = {r["component"]: r["gap"] for r in grouping.widest_gaps(timed).collect()}
    own = sorted(t for c, t in rows if c == 1)
    assert got == {1: max((b - a).seconds for a, b in zip(own, own[1:])), 2: None, 3: 0, 4: 7}
    assert grouping.widest_gaps(timed.limit(0)).count() == 0
    # The large component is found in several ranges.
    assert numbering.by_ranges(timed, "component", "t").where("component = 1").select("_range").distinct().count() > 1


def test_provenance_of_a_keeper_with_many_copies(spark, many_ranges):
    n = 30_000
    copies = spark.range(1, n + 1).selectExpr("id + 1 AS id", "1L AS dupe_of", "IF(id % 5 = 0, NULL, concat('f', id % 5000, '/g', id % 13, '/', id, '.jpg')) AS rel_path")
    keepers = spark.createDataFrame([(1, None, "own/1.jpg"), (10**9, None, None)], "id bigint, dupe_of bigint, rel_path string")
    files = copies.unionByName(keepers)
    told = {r["id"]: r for r in outcome.provenance(keepers, files, Config(provenance_prefix="from: ")).collect()}
    rels = ["own/1.jpg"] + [f"f{i % 5000}/g{i % 13}/{i}.jpg" for i in range(1, n + 1) if i % 5]
    assert told[1]["description"] == "from: " + " | ".join(rels)
    assert told[1]["keywords"] == sorted({p for r in rels for p in r.split("/")[:-1]})[:12]
    assert told[10**9]["description"] == "from: " and told[10**9]["keywords"] == []
    pieces = outcome.description_pieces(outcome.origins(keepers, files), 700).collect()
    assert max(p["line"].count(" | ") for p in pieces) == 699 and {p["piece"] for p in pieces} == set(range(len(pieces)))


# Review


def queue_of(spark, groups):
    """A queue with groups of the given sizes, larger files first by id."""
    rows, i = [], 0
    for g, n in enumerate(groups, 1):
        for k in range(n):
            i += 1
            rows.append({"role": "review", "status": "review", "group_id": g, "size": 10_000 - k // 2, "width": 5, "height": 5, "source_path": f'/src/{g}/"{k}", x</script>.jpg'})
    return review.queue(manifest(spark, *rows))


def test_pages_of_a_large_group(spark, tmp_path):
    queued = queue_of(spark, [3, 25, 1])
    none = spark.createDataFrame([], "file_id string, decision string, merge_from_file_id string")
    rows = review.decision_rows(queued, none)
    shown = review.payload(queued, rows, size=10)
    pages = {(r["gid"], r["page"]): [f["id"] for f in r["files"]] for r in shown.collect()}
    assert pages == {(1, 0): [1, 2, 3], (2, 0): list(range(4, 14)), (2, 1): list(range(14, 24)), (2, 2): list(range(24, 29)), (3, 0): [29]}
    index = sinks.write_review_page(shown, str(tmp_path / "review.html"), "/work", on_page=8).orderBy("part").collect()
    assert len(index) > 1 and sum(r["rows"] for r in index) == 5
    text = (tmp_path / "review.html").read_text("utf-8")
    assert re.findall(r'href="([^"]*)"', text) == [f"review_pages/{r['file']}" for r in index]
    seen = []
    for r in index:
        page = (tmp_path / "review_pages" / r["file"]).read_text("utf-8")
        data = json.loads(re.search(r'<script id="data"[^>]*>(.*?)</script>', page, re.S)[1])
        assert data["workdir"] == "/work" and (data["groups"][0]["gid"], data["groups"][-1]["gid"]) == (r["first"], r["last"])
        seen += [(g["gid"], g["page"], [f["id"] for f in g["files"]]) for g in data["groups"]]
    assert seen == sorted((g, p, ids) for (g, p), ids in pages.items())
    sinks.write_review_page(shown, str(tmp_path / "review.html"), "/work")
    assert len(re.findall('"gid":', (tmp_path / "review.html").read_text("utf-8"))) == 5


def test_decisions_are_written_in_parts(spark, many_ranges, tmp_path):
    queued = queue_of(spark, [40, 2, 1])
    prior = spark.createDataFrame([("2", "Skip", ""), ("41", "keep", "42")], "file_id string, decision string, merge_from_file_id string")
    path = tmp_path / "decisions.csv"
    index = sinks.write_decisions(review.decision_rows(queued, prior), str(path)).orderBy("part").collect()
    assert len(index) > 1 and sum(r["rows"] for r in index) == 43
    rows = list(csv.DictReader(path.open(newline="", encoding="utf-8")))
    assert [int(r["file_id"]) for r in rows] == list(range(1, 44)) and path.read_bytes().count(b"\r\n") == 44
    assert rows[0]["source_path"] == '/src/1/"0", x</script>.jpg' and (rows[40]["decision"], rows[40]["merge_from_file_id"]) == ("keep", "42")
    parts = [(tmp_path / "decisions.csv.parts" / r["file"]).read_bytes() for r in index]
    assert b"".join(parts) == path.read_bytes().split(b"\r\n", 1)[1]
    assert decision_files.read_decisions(spark, str(path)).count() == 43
    assert sinks.write_decisions(review.decision_rows(queued.limit(0), prior), str(path)).count() == 0
    assert path.read_bytes().count(b"\r\n") == 1


def test_click_fold_equals_one_by_one(spark):
    rng = random.Random(4)
    files, clicks = [], []
    for g in range(40):
        ids = [100 * g + k for k in range(rng.randrange(1, 5))]
        files += [(g, f, rng.choice(["", "", "Keep", "skip", "x", None]), rng.choice(["", "", str(rng.choice(ids)), None])) for f in ids]
        clicks += [(g, s, rng.choice([*ids, *ids, 9999]), rng.choice(["keep", "keep", "donate", "other"])) for s in range(rng.randrange(12))]
    got = review.fold_clicks(
        spark.createDataFrame(files, "group_id bigint, file_id bigint, decision string, merge_from_file_id string"),
        spark.createDataFrame(clicks, "group_id bigint, seq bigint, file_id bigint, action string").repartition(3),
    )
    want = []
    for g in range(40):
        own = [f for f in files if f[0] == g]
        state = {f: d.lower() if (d or "").lower() in ("keep", "skip") else "" for _, f, d, _ in own}
        donor = next((int(m) for _, f, _, m in reversed(own) if state[f] == "keep" and m), None)
        for _, _, f, action in sorted(c for c in clicks if c[0] == g):
            donor = review.click(state, donor, f, action)
        want += review.merged_rows(g, state, donor)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


# Files


def test_a_deep_folder_is_walked_by_several_tasks(spark, tmp_path):
    rng, folders = random.Random(5), [tmp_path / "root"]
    for k in range(120):
        folders.append(rng.choice(folders[-6:]) / rng.choice(["a b", "a.b", ".hid", f"d{k}", "é"]))
    for k, folder in enumerate(folders):
        folder.mkdir(parents=True, exist_ok=True)
        for name in rng.sample(["x.jpg", "y z.JPG", ".dot.jpg", "note.txt", "no_suffix"], 3):
            (folder / name).write_text(str(k))
    (tmp_path / "root" / "link").symlink_to(folders[3], target_is_directory=True)
    (tmp_path / "root" / "linked.jpg").symlink_to(folders[0])
    root = str(tmp_path / "root")
    want = {os.path.join(at, n) for at, _, names in os.walk(root) for n in names if not n.startswith(".") and os.path.isfile(os.path.join(at, n))}
    for step in (1, 10, 10**6):
        rows = sources.listed(spark, [(root, 0)], step).collect()
        assert sorted(r["source_path"] for r in rows) == sorted(want)
        assert all(r["rel_path"] == os.path.relpath(r["source_path"], root) and r["size"] == os.path.getsize(r["source_path"]) for r in rows)
        assert (len({r["task"] for r in rows}) > 1) == (step < 10**6)
    media = sources.walk(spark, [root, str(tmp_path / "missing"), root], Config()).collect()
    assert sorted({r["source_path"] for r in media}) == sorted(p for p in want if p.lower().endswith(".jpg"))
    assert {r["root_position"] for r in media} == {0, 2}


def test_paths_are_in_the_order_of_their_parts(spark):
    names = ["a/b", "a b/c", "a.b", "a-b/z", "a", "A/z", "a/b c", "a/b/c", "ab", "é/a", "a!/x", "a/.b"]
    paths = spark.createDataFrame([(f"/r/{n}",) for n in names], "source_path string")
    got = [r[0] for r in paths.orderBy(sources.path_order(F.col("source_path"))).collect()]
    assert got == [str(p) for p in sorted(Path(f"/r/{n}") for n in names)]


def test_two_writers_never_share_a_number(spark, tmp_path):
    stores, runs, versions = [Store(spark, f"file://{tmp_path}/state") for _ in range(2)], [], []
    stores[0].schema_version()
    start = threading.Barrier(2)

    def work(store):
        start.wait()
        for _ in range(5):
            runs.append(store._claim("run", 1))
            versions.append(store._claim("v", 1))

    threads = [threading.Thread(target=work, args=(s,)) for s in stores]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(runs) == sorted(versions) == list(range(1, 11))
    # A number that was claimed by a run that never wrote anything isn't given again.
    assert stores[0].new_run("plan", {}) == 11 and stores[1].new_run("plan", {}) == 12
    stores[0].write_files(manifest(spark, {"source_path": "/a"}))
    stores[1].write_files(manifest(spark, {"source_path": "/b"}))
    assert [r["source_path"] for r in stores[0].files().collect()] == ["/b"]


def test_schema_version_is_stamped_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/state")
    assert store.versions().count() == 0
    store.new_run("scan", {})
    store.new_run("scan", {})
    assert [r["version"] for r in store.versions().collect()] == [1]
    spark.createDataFrame([(99,)], "version int").write.mode("append").parquet(f"{tmp_path}/state/schema_version")
    with pytest.raises(ValueError, match="99"):
        store.new_run("scan", {})


def slow_hash(grey):
    n = len(grey)
    c = [[2 * math.cos(math.pi * u * (2 * i + 1) / (2 * n)) for i in range(n)] for u in range(8)]
    freq = [sum(grey[i][j] * c[u][i] * c[v][j] for i in range(n) for j in range(n)) for u in range(8) for v in range(8)]
    middle = statistics.median(freq)
    return f"{int(''.join('1' if f > middle else '0' for f in freq), 2):016x}"


def test_perceptual_hashes(spark):
    rng = random.Random(6)
    pictures = [[[rng.randrange(256) for _ in range(32)] for _ in range(32)] for _ in range(4)]
    assert phash.hex_hashes(np.array(pictures)) == [slow_hash(p) for p in pictures]
    # Brighter, darker and less contrast are the same picture; the negative has all bits but the first turned.
    one = np.array(pictures[:1])
    assert phash.hex_hashes(one * 2 + 9) == phash.hex_hashes(one)
    turned = int(phash.hex_hashes(255 - one)[0], 16) ^ int(phash.hex_hashes(one)[0], 16)
    assert bin(turned).count("1") >= 62
    rows = [([float(x) for r in pictures[0][:8] for x in r[:8]],), (None,), ([1.0],), ([None] * 64,)]
    got = spark.createDataFrame(rows, "e array<double>").select(phash.hash_column(F.col("e"), 8)).collect()
    assert [r[0] for r in got] == [slow_hash([r[:8] for r in pictures[0][:8]]), None, None, None]


STUB = """#!/usr/bin/env python3
import json, sys
lines = sys.stdin.read().split("\\n")[:-1] if "-@" in sys.argv else sys.argv[1:]
with open({log!r}, "a") as f:
    f.write(json.dumps(lines) + "\\n")
if "-j" in lines:
    paths = [x for x in lines[lines.index("-j"):] if x.startswith("/")]
    if any("broken" in p for p in paths):
        sys.exit("no JSON")
    print(json.dumps([{{"SourceFile": p, "Model": "M", "ImageWidth": 7, "CreateDate": "2017:01:02 03:04:05"}} for p in paths]))
"""


@pytest.fixture
def exiftool(spark, tmp_path, monkeypatch):
    """A program that writes down what it is asked."""
    log = tmp_path / "asked"
    log.touch()
    tool = tmp_path / "bin" / "exiftool"
    tool.parent.mkdir()
    tool.write_text(STUB.format(log=str(log)))
    tool.chmod(tool.stat().st_mode | stat.S_IXUSR)
    path = f"{tool.parent}:{os.environ['PATH']}"
    monkeypatch.setenv("PATH", path)
    monkeypatch.setitem(spark.sparkContext.environment, "PATH", path)
    return lambda: [json.loads(x) for x in log.read_text().splitlines()]


def test_metadata_is_read_in_batches(spark, exiftool):
    paths = spark.createDataFrame([(f"/s/{k}.jpg",) for k in range(5)] + [("/s/broken.jpg",)], "source_path string").repartition(1).sortWithinPartitions("source_path")
    rows = sources.metadata(paths, Config(exiftool_batch=2)).collect()
    assert sources.exiftool_available()
    assert [r["source_path"] for r in rows] == ["/s/0.jpg", "/s/1.jpg", "/s/2.jpg", "/s/3.jpg"]  # the last batch has a broken one
    assert (rows[0]["Model"], rows[0]["ImageWidth"], rows[0]["CreateDate"], rows[0]["DateTimeOriginal"]) == ("M", "7", "2017:01:02 03:04:05", None)
    asked = exiftool()
    assert len(asked) == 3 and all(x[:3] == ["-j", "-n", "-fast2"] for x in asked)
    assert [len([p for p in x if p.startswith("/")]) for x in asked] == [2, 2, 2]


def test_provenance_is_embedded_and_metadata_merged(spark, exiftool, tmp_path):
    told = [(1, f"{tmp_path}/a.jpg", ".jpg", ["k1", "k2"]), (2, f"{tmp_path}/b.cr2", ".cr2", ["k&"]), (3, f"{tmp_path}/c.cr2", ".cr2", None)]
    copied = spark.createDataFrame(told, "id bigint, dest_path string, ext string, keywords array<string>")
    pieces = spark.createDataFrame([(2, 1, "z"), (1, 0, "x/a.jpg"), (2, 0, "<y>")], "id bigint, piece bigint, line string")
    cfg = Config(provenance_prefix="from & ")
    assert {tuple(r) for r in sinks.write_provenance(copied, pieces, cfg).collect()} == {(1, "embedded"), (2, "sidecar"), (3, "sidecar")}
    column = outcome.sidecar(F.col("d"), F.col("k"))
    for name, description, keywords in (("b", "from & <y> | z", ["k&"]), ("c", "from & ", [])):
        want = spark.createDataFrame([(description, keywords)], "d string, k array<string>").select(column).first()[0]
        assert (tmp_path / f"{name}.cr2.xmp").read_text("utf-8") == want
    assert sorted(p.name for p in tmp_path.glob("*.cr2*")) == ["b.cr2.xmp", "c.cr2.xmp"]
    assert exiftool() == [["-overwrite_original", "-XMP-dc:Description=from & x/a.jpg", "-XMP-dc:Subject=k1", "-XMP-dc:Subject=k2", f"{tmp_path}/a.jpg", "-execute"]]
    jobs = spark.createDataFrame([(1, 2, "/s/donor.jpg", "/lib/keeper.jpg")], "keeper_id bigint, donor_id bigint, donor_path string, keeper_dest string")
    assert [tuple(r) for r in sinks.merge_into_files(jobs).collect()] == [(1, 2)]
    assert exiftool()[-1] == ["-overwrite_original", "-wm", "cg", "-tagsfromfile", "/s/donor.jpg", "-all:all", "/lib/keeper.jpg"]


def test_a_scan_without_exiftool_is_refused(monkeypatch, tmp_path):
    from reelhouse import __main__ as command

    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(SystemExit, match="exiftool"):
        command.main(["--workdir", str(tmp_path), "scan", str(tmp_path)])
    assert not list(tmp_path.iterdir())


def test_no_thumbnails_without_the_library(spark, tmp_path):
    try:
        import PIL  # noqa: F401
    except ImportError:
        (tmp_path / "1.jpg").write_text("made before")
        rows = spark.createDataFrame([(1, "/s/1.jpg"), (2, "/s/2.jpg")], "id bigint, source_path string")
        assert [r["id"] for r in sinks.make_thumbnails(rows, str(tmp_path)).collect()] == [1]


def test_decision_files_are_read_by_their_header(spark, tmp_path):
    path = tmp_path / "d.csv"
    text = 'decision,file_id,note,source_path,merge_from_file_id\r\n Keep ,1,x,"a ""b"", c\r\nd é",\r\nskip,2,,plain,7\r\n,3\r\nskip,1,x,y,z\r\n'
    path.write_bytes(text.encode())
    rows = decision_files.read_decisions(spark, str(path)).orderBy("line").collect()
    with path.open(newline="", encoding="utf-8") as f:
        want = [{c: (r.get(c) or "").replace("\r\n", "\n") for c in ("group_id", "file_id", "source_path", "decision", "merge_from_file_id")} for r in csv.DictReader(f)]
    assert [{c: r[c] for c in w} for r, w in zip(rows, want)] == want and len(rows) == 4
    assert {tuple(r) for r in review.accepted_decisions(decision_files.read_decisions(spark, str(path)).where("file_id = 2")).collect()} == {(2, "skip", 7)}
    path.write_text("")
    assert decision_files.read_decisions(spark, str(path)).count() == 0
    assert decision_files.read_decisions(spark, None).count() == decision_files.read_decisions(spark, str(tmp_path / "no")).count() == 0
