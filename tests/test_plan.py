from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reelhouse.config import Config
from reelhouse.operators import components, incremental, summary
from reelhouse.plans.plan import plan
from reelhouse.schema import FILES

CFG = Config(max_year=2030)


def manifest(spark, *rows):
    full = []
    for i, row in enumerate(rows, 1):
        path = row.get("source_path", f"/src/{i}.jpg")
        base = {"id": i, "source_path": path, "source_root": "/src", "rel_path": path.removeprefix("/src/"), "size": 100, "mtime": 1.0e9 + i}
        base |= {"ext": ".jpg", "kind": "image", "content_hash": f"{i:040x}", "status": "scanned"} | row
        full.append(tuple(base.get(f) for f in FILES.fieldNames()))
    return spark.createDataFrame(full, FILES)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


LIBRARY = [
    {"source_path": "/src/Old Laptop/Holiday 2015/beach.jpg", "content_hash": "b", "exif_date": "2015:07:14 10:30:00", "camera": "C", "phash": "f0f0f0f0f0f0f0f0"},
    {"source_path": "/src/Random/beach copy.jpg", "content_hash": "b", "exif_date": "2015:07:14 10:30:00", "camera": "C", "phash": "f0f0f0f0f0f0f0f0"},
    {"source_path": "/src/Phone Backup/Camera/IMG_20190304_101112.jpg", "phash": "123456789abcdef0"},
    {"source_path": "/src/Random/sunset_big.jpg", "width": 1000, "height": 750, "phash": "00000000ffffffff", "size": 900},
    {"source_path": "/src/Random/sunset_small.jpg", "width": 400, "height": 300, "phash": "00000000fffffff0"},
    {"source_path": "/src/Old Laptop/Holiday 2015/mountain.jpg", "phash": "aaaaaaaaaaaaaaaa"},
    {"source_path": "/src/Old Laptop/Holiday 2015/mountain.dng", "kind": "raw", "ext": ".dng"},
    {"source_path": "/src/Old Laptop/Holiday 2015/no_meta.png", "ext": ".png", "phash": "cccccccc33333333"},
    *(
        {"source_path": f"/src/Old Laptop/Holiday 2015/burst_{i}.jpg", "exif_date": f"2016:01:01 10:00:0{2 * i}", "camera": "C", "phash": "0123012301230123"}
        for i in range(3)
    ),
]


def test_whole_plan(spark):
    rows = by_id(plan(manifest(spark, *LIBRARY), CFG))
    roles = [rows[i]["role"] for i in range(1, 12)]
    assert roles == ["keep", "exact_dupe", "keep", "review", "review", "raw_jpeg_pair", "raw_jpeg_pair", "keep", "burst", "burst", "burst"]
    sources = [rows[i]["date_source"] for i in range(1, 12)]
    assert sources == ["exif", "exif", "filename", "mtime", "mtime", "folder", "folder", "folder", "exif", "exif", "exif"]
    assert rows[2]["dupe_of"] == 1 and rows[1]["group_id"] == rows[2]["group_id"]
    assert rows[4]["status"] == "review" and rows[1]["status"] == "planned"
    assert len({rows[i]["group_id"] for i in (1, 4, 6, 9)}) == 4
    counts = summary.plan_counts(plan(manifest(spark, *LIBRARY), CFG)).first()
    assert tuple(counts) == (1, 1, 1, 1)


def test_planning_twice_changes_nothing(spark):
    once = plan(manifest(spark, *LIBRARY), CFG)
    a, b = by_id(once), by_id(plan(once, CFG))
    same = ("role", "dupe_of", "status", "date_taken", "date_source", "exif_date")
    assert {i: tuple(r[c] for c in same) for i, r in a.items()} == {i: tuple(r[c] for c in same) for i, r in b.items()}


def test_keepers(spark):
    twice = {"content_hash": "x"}
    rows = by_id(plan(manifest(spark, twice | {"mtime": 1577836800.0}, twice | {"mtime": 1514764800.0}), CFG))
    assert (rows[1]["role"], rows[1]["dupe_of"], rows[2]["role"]) == ("exact_dupe", 2, "keep")
    rows = by_id(plan(manifest(spark, twice, twice | {"status": "copied", "mtime": 2e9}), CFG))
    assert (rows[1]["dupe_of"], rows[2]["role"], rows[2]["status"]) == (2, "keep", "copied")
    rows = by_id(plan(manifest(spark, twice | {"mtime": None}, twice | {"mtime": None}), CFG))
    assert rows[2]["dupe_of"] == 1


def test_live_pair_takes_the_images_date(spark):
    pair = [
        {"source_path": "/src/Clip.jpg", "exif_date": "2017:05:01 09:15:30"},
        {"source_path": "/src/clip.mp4", "kind": "video", "ext": ".mp4"},
        {"source_path": "/src/clip.xmp", "kind": "sidecar", "ext": ".xmp"},
    ]
    rows = by_id(plan(manifest(spark, *pair), CFG))
    assert [rows[i]["role"] for i in (1, 2, 3)] == ["keep", "live_pair", "keep"]
    assert (rows[2]["date_taken"], rows[2]["date_source"]) == ("2017-05-01T09:15:30", "exif")
    assert len({rows[i]["group_id"] for i in (1, 2, 3)}) == 1


def test_a_companion_joins_two_others_and_then_leaves(spark):
    rows = [
        {"phash": "0000000000000000"},
        {"phash": "000000000000001f", "source_path": "/src/m.jpg"},
        {"phash": "00000000000003ff"},
        {"kind": "raw", "ext": ".dng", "source_path": "/src/m.dng"},
    ]
    found = by_id(plan(manifest(spark, *rows), CFG))
    assert [found[i]["role"] for i in (1, 2, 3, 4)] == ["review", "raw_jpeg_pair", "review", "raw_jpeg_pair"]


@pytest.mark.parametrize(
    "times, cameras, want",
    [
        (("10:00:00", "10:00:10"), ("C", "C"), "burst"),
        (("10:00:00", "10:00:11"), ("C", "C"), "review"),
        (("10:00:00", None), ("C", "C"), "review"),
        (("10:00:00", "10:00:01"), ("C", "D"), "review"),
        (("10:00:00", "10:00:01"), (None, None), "review"),
        (("10:00:00", "10:00:01"), ("C", None), "review"),
    ],
)
def test_bursts(spark, times, cameras, want):
    rows = [{"phash": "00", "exif_date": t and f"2016:01:01 {t}", "camera": c} for t, c in zip(times, cameras)]
    assert {r["role"] for r in plan(manifest(spark, *rows), CFG).collect()} == {want}


def test_statuses_that_last(spark):
    rows = [
        {"status": "skipped_manual", "content_hash": "x", "role": "review", "group_id": 7},
        {"content_hash": "x"},
        {"status": "error", "content_hash": None, "error": "gone"},
        {"status": "planned", "content_hash": None, "role": "keep"},
    ]
    found = by_id(plan(manifest(spark, *rows), CFG))
    assert (found[1]["status"], found[1]["role"], found[1]["group_id"]) == ("skipped_manual", "review", 7)
    assert (found[2]["status"], found[2]["role"], found[2]["dupe_of"]) == ("planned", "keep", None)
    assert found[3]["status"] == "error"
    assert (found[4]["status"], found[4]["role"]) == ("scanned", None)


def test_an_empty_manifest(spark):
    assert plan(manifest(spark), CFG).collect() == []


@pytest.mark.parametrize("radius", [0, 2, 5, 15, 16])
def test_blocked_links_are_those_of_all_pairs(spark, radius):
    rng = random.Random(radius)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    hashes += [h ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 8))) & (2**64 - 1) for h in hashes for _ in range(2)]
    signed = sorted({h - 2**64 if h >= 2**63 else h for h in hashes})
    df = spark.createDataFrame([(h,) for h in signed + signed[:5]], "h bigint")
    got = {(r["a"], r["b"]) for r in components.hamming_links(df, radius).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert got == want


def test_components_are_the_transitive_closure(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (200, 200)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    nodes = spark.createDataFrame([(7,), (300,)], "node bigint")
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint"), nodes).collect()}
    assert got == {7: 0, 300: 300}


def test_incremental_scan(spark):
    known = manifest(spark, {"mtime": 10.0, "phash": "1"}, {"mtime": 10.0}, {"mtime": 10.0, "status": "copied", "dest_path": "/d"}, {"mtime": 10.0})
    walked = known.select("source_path", "source_root", "rel_path", "size", "mtime", "ext", "kind").withColumn("root_position", F.lit(0))
    walked = walked.withColumn("mtime", F.when(F.col("source_path") == "/src/1.jpg", 11.0).when(F.col("source_path") == "/src/2.jpg", 10.9).otherwise(10.0))
    walked = walked.withColumn("size", F.when(F.col("source_path") == "/src/3.jpg", 101).otherwise(F.col("size")))
    new = spark.createDataFrame([("/src/z.jpg", "/src", "z.jpg", 1, 1.0, ".jpg", "image", 0), ("/src/z.jpg", "/", "src/z.jpg", 1, 1.0, ".jpg", "image", 1)], walked.schema)
    changed = incremental.changed_files(walked.unionByName(new), known)
    assert sorted(r["source_path"] for r in changed.collect()) == ["/src/1.jpg", "/src/3.jpg", "/src/z.jpg"]
    rows = by_id(incremental.upsert(known, changed))
    assert (rows[1]["content_hash"], rows[1]["phash"], rows[1]["mtime"]) == (None, None, 11.0)
    assert rows[2]["content_hash"] is not None
    assert (rows[3]["status"], rows[3]["dest_path"]) == ("scanned", "/d")
    assert (rows[5]["source_path"], rows[5]["source_root"], rows[5]["status"]) == ("/src/z.jpg", "/src", "scanned")
