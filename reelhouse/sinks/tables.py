"""Snapshots of the manifest, and the logs of runs and actions."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.outcome import log_lines
from ..schema import ACTIONS, FILES, RUNS, SCHEMA_VERSION, VERSIONS


class Store:
    """A library's state below one folder of any file system that Spark writes to.

    Every change of the manifest is a new snapshot, ``files/v=N``; a reader takes the newest one that
    was finished, so a write that fails halfway changes nothing. Runs and actions are appended.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/files")
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        names = ((s.getPath().getName(), s.getPath()) for s in fs.listStatus(folder))
        done = (n for n, p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        return sorted(int(m[1]) for n in done if (m := re.fullmatch(r"v=(\d+)", n)))

    def files(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.path}/files/v={versions[-1]}")

    def _claim(self, kind: str, number: int) -> int:
        """The first number from ``number`` on that no one else has claimed: a file of that name is made, which only one can do."""
        while not _create(self.spark, f"{self.path}/claims/{kind}={number}"):
            number += 1
        return number

    def write_files(self, manifest: DataFrame) -> DataFrame:
        version = self._claim("v", max(self._versions(), default=0) + 1)
        manifest.select(*FILES.fieldNames()).write.parquet(f"{self.path}/files/v={version}")
        return self.files()

    def _appended(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._appended("runs", RUNS)

    def actions(self) -> DataFrame:
        return self._appended("actions", ACTIONS)

    def versions(self) -> DataFrame:
        return self._appended("schema_version", VERSIONS)

    def schema_version(self) -> int:
        """The version of the schema that the state was written with; a state without one gets this library's."""
        found = self.versions().agg(F.count("*"), F.max("version")).first()
        if not found[0]:
            self.spark.createDataFrame([(SCHEMA_VERSION,)], VERSIONS).write.mode("append").parquet(f"{self.path}/schema_version")
        return found[1] or SCHEMA_VERSION

    def new_run(self, command: str, args: dict) -> int:
        if (version := self.schema_version()) != SCHEMA_VERSION:
            raise ValueError(f"the state has schema version {version}, this library {SCHEMA_VERSION}")
        number = self._claim("run", (self.runs().agg(F.max("id")).first()[0] or 0) + 1)
        row = (number, now(), command, json.dumps(args, sort_keys=True))
        self.spark.createDataFrame([row], RUNS).write.mode("append").parquet(f"{self.path}/runs")
        return number

    def log(self, actions: DataFrame, run_id: int, command: str) -> None:
        """Append actions to the table, and as JSON lines below ``logs/run=N/cmd=...``."""
        actions = actions.select(*ACTIONS.fieldNames())
        actions.write.mode("append").parquet(f"{self.path}/actions")
        log_lines(actions).write.mode("append").json(f"{self.path}/logs/run={run_id:04}/cmd={command}")


def _create(spark: SparkSession, path: str) -> bool:
    """Make a file that must not exist; False if it does. Of several who try at once, one gets True."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":  # whose create() looks first and then makes the file
        local = at.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(at, False).close()
    except Exception as e:
        if "FileAlreadyExists" not in str(e) and not fs.exists(at):
            raise
        return False
    return True


def now() -> str:
    return datetime.now().isoformat(timespec="seconds")
