"""What Python workers run is found by them, wherever they start."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
CODE = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as entry
for name in ("hamming_edges_wide", "perceptual_hashes", "blake2_hash"):
    print(name, entry.queries()[name](spark, {sf!r}).count())
from reelhouse.config import Config
from reelhouse.plans.library import Library
folder = tempfile.mkdtemp()
library = Library(spark, folder + "/work", Config())
open(folder + "/a.jpg", "w").write("a")
print("scan", library.scan([folder]).count())
library.plan()
print("apply", library.apply(folder + "/out").first()[0])
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_workers_that_start_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_DIRS": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "scan 1" in done.stdout and "apply 1" in done.stdout
