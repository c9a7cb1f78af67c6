from __future__ import annotations

import json

from pyspark.sql import functions as F

from reelhouse.config import Config
from reelhouse.operators import outcome, review

from .test_plan import by_id, manifest

QUEUE = [
    {"role": "review", "status": "review", "group_id": 7, "width": 4000, "height": 3000, "size": 2_000_000, "source_path": "/src/a.jpg", "camera": "C"},
    {"role": "review", "status": "review", "group_id": 7, "width": 1600, "height": 1200, "size": 300_000, "source_path": "/src/b, with </script>.jpg"},
    {"role": "keep", "status": "planned"},
    {"role": "review", "status": "skipped_manual", "group_id": 8, "width": None, "size": None},
]


def test_queue_and_decision_rows(spark):
    queued = review.queue(manifest(spark, *QUEUE))
    rows = {r["id"]: (r["suggested"], r["best_res"], r["best_size"]) for r in queued.collect()}
    assert rows == {1: (True, True, True), 2: (False, False, False), 4: (True, False, False)}
    prior = spark.createDataFrame([(0, "1", "skip", ""), (1, "1", " Keep ", "2"), (2, "2", "  ", "")], "line bigint, file_id string, decision string, merge_from_file_id string")
    got = {r["file_id"]: tuple(r)[3:] for r in review.decision_rows(queued, review.prior_decisions(prior)).collect()}
    assert got == {
        1: ("4000x3000", 1953, "keep", " Keep ", "2"),
        2: ("1600x1200", 293, "keep?", "", ""),
        4: ("NonexNone", 0, "keep", "", ""),
    }
    taken = {r["file_id"]: (r["decision"], r["merge_from"]) for r in review.accepted_decisions(prior).collect()}
    assert taken == {1: ("keep", 2)}


def test_payload_is_safe_in_a_script(spark):
    queued = review.queue(manifest(spark, *QUEUE))
    none = spark.createDataFrame([], "file_id string, decision string, merge_from_file_id string")
    shown = review.payload(queued, review.decision_rows(queued, none), spark.createDataFrame([(1,)], "id bigint"))
    from reelhouse.functions.text import script_safe

    lines = {r["gid"]: r["j"] for r in shown.select("gid", script_safe(F.to_json("files")).alias("j")).collect()}
    assert "</script>" not in lines[7]
    files = json.loads(lines[7])
    assert [f["id"] for f in files] == [1, 2]
    assert files[0]["thumb"] == "thumbs/1.jpg" and "thumb" not in files[1]
    assert files[0]["csv"] == {"resolution": "4000x3000", "size_kb": 1953, "suggestion": "keep"}


def test_clicks():
    d = {1: "", 2: "", 3: ""}
    assert review.click(d, None, 1, "keep") is None and d == {1: "keep", 2: "skip", 3: "skip"}
    donor = review.click(d, None, 2, "donate")
    assert donor == 2
    assert review.click(d, donor, 1, "donate") == 2  # a kept file can't donate
    donor = review.click(d, donor, 2, "keep")
    assert donor is None and d == {1: "keep", 2: "keep", 3: "skip"}
    review.click(d, donor, 1, "keep")
    assert d == {1: "skip", 2: "keep", 3: "skip"}
    assert review.click(d, 3, 2, "keep") is None and d == {1: "", 2: "", 3: ""}


def test_clicks_fold_by_group(spark):
    files = spark.createDataFrame([(1, 1, "", ""), (1, 2, "Keep", "3"), (1, 3, "skip", ""), (2, 9, "x", "")], "group_id bigint, file_id bigint, decision string, merge_from_file_id string")
    clicks = spark.createDataFrame([(1, 2, 3, "donate"), (1, 1, 1, "keep"), (1, 3, 3, "donate"), (3, 1, 50, "keep")], "group_id bigint, seq bigint, file_id bigint, action string")
    got = {tuple(r) for r in review.fold_clicks(files, clicks).collect()}
    assert got == {(1, 1, "keep", "3"), (1, 2, "keep", "3"), (1, 3, "skip", ""), (2, 9, "", "")}


def test_routing_provenance_and_merges(spark):
    rows = [
        {"role": "keep", "status": "planned", "source_path": "/src/A&B/c.jpg", "dest_path": "/lib/1"},
        {"role": "exact_dupe", "status": "planned", "dupe_of": 1, "source_path": "/src/Z/A/c.jpg"},
        *({"role": "review", "status": "review", "dest_path": f"/lib/{i}"} for i in (3, 4, 5)),
        {"role": "review", "status": "copied"},
    ]
    files = manifest(spark, *rows)
    decisions = spark.createDataFrame([(3, "keep", 4), (4, "skip", None)], "file_id bigint, decision string, merge_from bigint")
    routed = outcome.route(files, decisions)
    assert {r["id"]: (r["action"], r["merge_from"]) for r in routed.collect()} == {
        1: ("copy", None), 2: ("skip_dupe", None), 3: ("copy", 4), 4: ("skip_manual", None), 5: ("held", None)
    }
    assert tuple(outcome.outcome_counts(routed).first()) == (2, 2, 1)
    told = by_id(outcome.provenance(routed.where("action = 'copy'"), files, Config()))
    assert told[1]["keywords"] == ["A", "A&B", "Z"]
    assert told[1]["description"] == "source: A&B/c.jpg | Z/A/c.jpg"
    jobs = outcome.merge_jobs(routed, files)
    assert [tuple(r) for r in jobs.collect()] == [(3, 4, "/src/4.jpg", "/lib/3")]
    done = by_id(outcome.applied(files, routed))
    assert [done[i]["status"] for i in range(1, 7)] == ["copied", "skipped_dupe", "copied", "skipped_manual", "review", "copied"]
    xmp = told_xmp(spark, "d", ["Holiday 2015", "A&B"])
    assert "<rdf:li>Holiday 2015</rdf:li><rdf:li>A&amp;B</rdf:li>" in xmp
    logged = {r["file_id"]: r["action"] for r in outcome.actions(routed, 1, "t").collect()}
    assert logged == {1: "copied", 2: "skipped_exact_dupe", 3: "copied", 4: "skipped_manual_review"}


def told_xmp(spark, description, keywords):
    df = spark.createDataFrame([(description, keywords)], "d string, k array<string>")
    return df.select(outcome.sidecar(F.col("d"), F.col("k"))).first()[0]
