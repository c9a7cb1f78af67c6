"""Schemas of the manifest, the run and action logs, and decisions."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

_FIELDS = (
    "id bigint, source_path string, source_root string, rel_path string, size bigint, mtime double, ext string, kind string,"
    " content_hash string, phash string, width int, height int, exif_date string, camera string, date_taken string,"
    " date_source string, date_confidence string, group_id bigint, dupe_of bigint, role string, status string,"
    " dest_path string, error string"
)
_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _struct(fields: str) -> T.StructType:
    named = (f.split() for f in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in named])


FILES = _struct(_FIELDS)
RUNS = _struct("id bigint, started string, command string, args string")
ACTIONS = _struct("run_id bigint, file_id bigint, action string, detail string, ts string")
VERSIONS = _struct("version int")
DECISIONS = _struct(
    "group_id string, file_id string, source_path string, resolution string, size_kb string, suggestion string,"
    " decision string, merge_from_file_id string"
)

ROLES = ("keep", "exact_dupe", "raw_jpeg_pair", "live_pair", "burst", "review")
#: Statuses that a new plan leaves as they are.
DURABLE = ("copied", "error", "skipped_manual")
#: Of those, the ones that a plan doesn't even give a new role.
FROZEN = ("error", "skipped_manual")
