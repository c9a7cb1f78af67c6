"""The registered queries over the given tables, each with DuckDB SQL for the same rows.

The tables hold no media files, so the queries run over a manifest that is derived from all of
``documents`` and ``events``: a document is a file, its text the content, the event of the same number
its modification time and camera. Perceptual hashes are the signs of the embeddings' components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import dates, phash, text
from .operators import components as graph
from .operators import grouping, incremental, outcome, review, summary
from .operators.numbering import numbered
from .plans.plan import last_group, plan, reset
from .sources import files as sources
from .sources.files import blake2b_column

CFG = Config(max_year=2030)
#: The bits within which embeddings' sign hashes are neighbours; the default of 5 has no pairs in the tables.
RADIUS, WIDE = 15, 18

_EXT = (".jpg", ".cr2", ".jpeg", ".mp4", ".png", ".xmp", ".heic")
_FOLDER = ("Holiday 2015", "Holiday_2015", "2010/Trip 1980", "stuff", "Archive 1980", "1980 2015")


def _pick(values: tuple[str, ...], number: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.expr(number).cast("int"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived manifest; see ``MANIFEST_SQL`` for the same in SQL."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    rows = docs.join(events, docs["doc_id"] == events["event_id"])
    pair = "(doc_id div 2)"
    stem = (
        F.when(F.expr(f"{pair} % 5 = 0"), F.expr(f"concat('IMG_20190304_101112_', {pair})"))
        .when(F.expr(f"{pair} % 5 = 1"), F.expr(f"concat('IMG-20180105-WA', {pair})"))
        .when(F.expr(f"{pair} % 5 = 2"), F.expr(f"concat('scan 2017-03-4 n', {pair})"))
        .when(F.expr(f"{pair} % 5 = 3"), F.expr(f"concat('pic (', {pair}, ')!')"))
        .otherwise(F.expr(f"concat('20191399_2511', {pair})"))
    )
    ext = _pick(_EXT, "doc_id % 7")
    rel = F.concat(F.expr(f"concat('Box', {pair} % 4, '/')"), _pick(_FOLDER, f"{pair} % 6"), F.lit("/"), stem, ext)
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1000000D")
    exif = (
        F.when(F.expr("doc_id % 5 = 1"), "0000:00:00 00:00:00")
        .when(F.expr("doc_id % 5 = 2"), "2015:02:30 10:00:00")
        .when(F.expr("doc_id % 5 > 2"), F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    )
    return rows.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/src/"), rel).alias("source_path"),
        F.lit("/src").alias("source_root"),
        rel.alias("rel_path"),
        F.col("n_chars").cast("long").alias("size"),
        seconds.alias("mtime"),
        ext.alias("ext"),
        text.classify(ext, CFG).alias("kind"),
        F.md5(F.col("text").cast("binary")).alias("content_hash"),
        F.lit(None).cast("string").alias("phash"),
        F.expr("IF(doc_id % 11 = 0, NULL, CAST(n_chars % 4000 AS INT))").alias("width"),
        F.expr("IF(doc_id % 11 = 0, NULL, CAST(n_chars % 3000 AS INT))").alias("height"),
        exif.alias("exif_date"),
        F.expr("IF(user_id % 5 = 0, NULL, concat('cam', user_id % 5))").alias("camera"),
        *(F.lit(None).cast("string").alias(c) for c in ("date_taken", "date_source", "date_confidence")),
        *(F.lit(None).cast("long").alias(c) for c in ("group_id", "dupe_of")),
        F.lit(None).cast("string").alias("role"),
        F.when(F.col("event_type") == "purchase", "copied").otherwise("scanned").alias("status"),
        *(F.lit(None).cast("string").alias(c) for c in ("dest_path", "error")),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


MANIFEST_SQL = f"""
manifest AS (
  SELECT doc_id AS id, '/src/' || rel AS source_path, rel AS rel_path, CAST(n_chars AS BIGINT) AS size,
    epoch_us(ts) / 1000000.0::DOUBLE AS mtime, ext,
    CASE WHEN ext IN ('.jpg', '.jpeg', '.png', '.heic') THEN 'image' WHEN ext = '.cr2' THEN 'raw' WHEN ext = '.mp4' THEN 'video'
      WHEN ext = '.xmp' THEN 'sidecar' ELSE 'other' END AS kind,
    md5(text) AS content_hash,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars % 4000 END AS width,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars % 3000 END AS height,
    CASE WHEN doc_id % 5 = 1 THEN '0000:00:00 00:00:00' WHEN doc_id % 5 = 2 THEN '2015:02:30 10:00:00'
      WHEN doc_id % 5 > 2 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') END AS exif_date,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'cam' || (user_id % 5) END AS camera,
    CASE WHEN event_type = 'purchase' THEN 'copied' ELSE 'scanned' END AS status
  FROM (
    SELECT *, 'Box' || (p % 4) || '/' || {_sql_list(_FOLDER)}[p % 6 + 1] || '/' || CASE p % 5
        WHEN 0 THEN 'IMG_20190304_101112_' || p WHEN 1 THEN 'IMG-20180105-WA' || p WHEN 2 THEN 'scan 2017-03-4 n' || p
        WHEN 3 THEN 'pic (' || p || ')!' ELSE '20191399_2511' || p END || ext AS rel
    FROM (SELECT *, doc_id // 2 AS p, {_sql_list(_EXT)}[doc_id % 7 + 1] AS ext
          FROM documents JOIN events ON doc_id = event_id)
  )
)"""

_DATES_SQL = r"""
names AS (SELECT *, regexp_extract(source_path, '[^/]*$') AS name FROM manifest),
found AS (
  SELECT *,
    CASE WHEN regexp_matches(exif_date, '\d{4}:\d{2}:\d{2}[ T]\d{2}:\d{2}:\d{2}') THEN try_cast(
      regexp_replace(regexp_extract(exif_date, '\d{4}:\d{2}:\d{2}[ T]\d{2}:\d{2}:\d{2}'), '(\d+):(\d+):(\d+)[ T](.*)', '\1-\2-\3 \4')
      AS TIMESTAMP) END AS e,
    try_cast(regexp_replace(regexp_extract(name, '(?:19|20)\d{6}[_\-. ]?\d{6}'),
      '(\d{4})(\d\d)(\d\d)[_\-. ]?(\d\d)(\d\d)(\d\d)', '\1-\2-\3 \4:\5:\6') AS TIMESTAMP) AS f1,
    try_cast(regexp_extract(name, '(?i)IMG-((?:19|20)\d{2})(\d{2})(\d{2})-WA', 1) || '-'
      || regexp_extract(name, '(?i)IMG-((?:19|20)\d{2})(\d{2})(\d{2})-WA', 2) || '-'
      || regexp_extract(name, '(?i)IMG-((?:19|20)\d{2})(\d{2})(\d{2})-WA', 3) AS TIMESTAMP) AS f2,
    try_cast(regexp_extract(name, '((?:19|20)\d{2})[-_.]([01]?\d)[-_.]([0-3]?\d)', 1) || '-'
      || lpad(regexp_extract(name, '((?:19|20)\d{2})[-_.]([01]?\d)[-_.]([0-3]?\d)', 2), 2, '0') || '-'
      || lpad(regexp_extract(name, '((?:19|20)\d{2})[-_.]([01]?\d)[-_.]([0-3]?\d)', 3), 2, '0') AS TIMESTAMP) AS f3,
    list_filter(list_transform(list_reverse(string_split(rel_path, '/')[:-2]),
      lambda p: try_cast(regexp_extract(p, '\b((?:19|20)\d{2})\b', 1) AS INT)), lambda y: y BETWEEN 1990 AND 2030)[1] AS y,
    make_timestamp(CAST(round(mtime * 1000000) AS BIGINT)) AS m
  FROM names
), checked AS (
  SELECT * REPLACE (
    CASE WHEN year(e) BETWEEN 1990 AND 2030 THEN e END AS e, CASE WHEN year(f1) BETWEEN 1990 AND 2030 THEN f1 END AS f1,
    CASE WHEN year(f2) BETWEEN 1990 AND 2030 THEN f2 END AS f2, CASE WHEN year(f3) BETWEEN 1990 AND 2030 THEN f3 END AS f3,
    CASE WHEN mtime <> 0 AND year(m) BETWEEN 1990 AND 2030 THEN m END AS m) FROM found
), dated AS (
  SELECT *, coalesce(f1, f2, f3) AS f, coalesce(e, f1, f2, f3, make_timestamp(y, 1, 1, 0, 0, 0), m) AS t,
    CASE WHEN e IS NOT NULL THEN 'exif' WHEN coalesce(f1, f2, f3) IS NOT NULL THEN 'filename' WHEN y IS NOT NULL THEN 'folder'
      WHEN m IS NOT NULL THEN 'mtime' ELSE 'none' END AS date_source
  FROM checked
)"""
_ISO = "CASE WHEN {t} IS NULL THEN NULL WHEN microsecond({t}) % 1000000 = 0 THEN strftime({t}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') END"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


_KEEPERS = f"""
WITH {MANIFEST_SQL}, ranked AS (
  SELECT *, first_value(id) OVER w AS keeper_id, row_number() OVER w AS nth, count(*) OVER (PARTITION BY content_hash) AS n_same
  FROM manifest WINDOW w AS (PARTITION BY content_hash ORDER BY status <> 'copied', mtime, id)
)"""


@_query(
    "keeper_plan",
    _KEEPERS
    + """ SELECT id, CASE WHEN nth = 1 THEN 'keep' ELSE 'exact_dupe' END AS role,
      CASE WHEN nth > 1 THEN keeper_id END AS dupe_of, CAST(n_same AS BIGINT) AS n_same FROM ranked""",
)
def keeper_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = grouping.exact_groups(manifest(spark, sf_dir))
    kept = F.col("id") == F.col("keeper_id")
    role = F.when(kept, "keep").otherwise("exact_dupe").alias("role")
    return files.select("id", role, F.when(~kept, F.col("keeper_id")).alias("dupe_of"), "n_same")


def _with_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = grouping.exact_groups(manifest(spark, sf_dir))
    role = F.when(F.col("id") == F.col("keeper_id"), "keep").otherwise("exact_dupe")
    return files.withColumn("role", role).withColumn("date_source", dates.resolve(CFG)["date_source"])


@_query(
    "status_counts",
    f"""{_KEEPERS}, {_DATES_SQL.replace("FROM manifest", "FROM ranked")}, facets AS (
      SELECT 'status' AS facet, status AS value FROM dated
      UNION ALL SELECT 'role', CASE WHEN nth = 1 THEN 'keep' ELSE 'exact_dupe' END FROM dated
      UNION ALL SELECT 'date_source', date_source FROM dated)
    SELECT facet, value, count(*) AS n FROM facets GROUP BY facet, value""",
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.status(_with_facets(spark, sf_dir))


@_query("classify_kind", f"WITH {MANIFEST_SQL} SELECT id, ext, kind FROM manifest")
def classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(spark, sf_dir).select("id", text.suffix(F.col("source_path")).alias("ext"))
    return found.select("id", "ext", text.classify(F.col("ext"), CFG).alias("kind"))


def _walked(files: DataFrame) -> DataFrame:
    """A later walk of the tree: some files are new, some longer, some touched, some only by half a second."""
    new = F.expr("id % 9 = 0")
    path = F.when(new, F.concat("source_path", F.lit(".new.jpg"))).otherwise(F.col("source_path"))
    size = F.expr("IF(id % 9 = 1, size + 1, size)")
    mtime = F.expr("CASE WHEN id % 9 = 2 THEN mtime + 1D WHEN id % 9 = 3 THEN mtime + 0.5D ELSE mtime END")
    return files.select(path.alias("source_path"), "source_root", "rel_path", size.alias("size"), mtime.alias("mtime"), "ext", "kind")


_WALKED_SQL = """walked AS (
  SELECT CASE WHEN id % 9 = 0 THEN source_path || '.new.jpg' ELSE source_path END AS source_path,
    CASE WHEN id % 9 = 1 THEN size + 1 ELSE size END AS size,
    CASE WHEN id % 9 = 2 THEN mtime + 1 WHEN id % 9 = 3 THEN mtime + 0.5 ELSE mtime END AS mtime FROM manifest
), changed AS (
  SELECT w.* FROM walked w WHERE NOT EXISTS (SELECT 1 FROM manifest m
    WHERE m.source_path = w.source_path AND m.size = w.size AND abs(m.mtime - w.mtime) < 1)
)"""


@_query("incremental_anti_join", f"WITH {MANIFEST_SQL}, {_WALKED_SQL} SELECT source_path, size, mtime FROM changed")
def incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = manifest(spark, sf_dir)
    return incremental.changed_files(_walked(files), files).select("source_path", "size", "mtime")


@_query(
    "upsert_snapshot",
    f"""WITH {MANIFEST_SQL}, {_WALKED_SQL}
    SELECT m.id, m.source_path, coalesce(c.size, m.size) AS size, coalesce(c.mtime, m.mtime) AS mtime,
      CASE WHEN c.source_path IS NOT NULL THEN 'scanned' ELSE m.status END AS status,
      CASE WHEN c.source_path IS NULL THEN m.content_hash END AS content_hash
    FROM manifest m LEFT JOIN changed c USING (source_path)
    UNION ALL
    SELECT (SELECT max(id) FROM manifest) + row_number() OVER (ORDER BY string_split(source_path, '/')), source_path, size, mtime, 'scanned', NULL
    FROM changed WHERE source_path NOT IN (SELECT source_path FROM manifest)""",
)
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = manifest(spark, sf_dir)
    merged = incremental.upsert(files, incremental.changed_files(_walked(files), files))
    return merged.select("id", "source_path", "size", "mtime", "status", "content_hash")


_PAIRS_SQL = f"""{_KEEPERS}, keyed AS (
  SELECT *, lower(regexp_replace(source_path, '\\.[^./]+$', '')) AS pair_key FROM ranked WHERE nth = 1
), kinds AS (
  SELECT pair_key, bool_or(kind = 'raw') AS r, bool_or(kind = 'image') AS i, bool_or(kind = 'video') AS v,
    arg_min(exif_date, id) FILTER (WHERE kind = 'image' AND exif_date IS NOT NULL) AS any_exif,
    min(id) FILTER (WHERE kind = 'image') AS first_image
  FROM keyed GROUP BY pair_key
), pairs AS (
  SELECT k.id, k.kind, k.exif_date, k.pair_key, CASE WHEN r AND i THEN 'raw' ELSE 'live' END AS pair, f.exif_date AS image_exif
  FROM keyed k JOIN kinds USING (pair_key) LEFT JOIN keyed f ON f.id = first_image WHERE (r AND i) OR (v AND i)
)"""


@_query("companion_groups", _PAIRS_SQL + " SELECT id, pair_key, pair FROM pairs")
def companion_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = grouping.exact_groups(manifest(spark, sf_dir)).where("id = keeper_id")
    return grouping.companions(files).select("id", "pair_key", "pair")


@_query(
    "live_pair_date",
    _PAIRS_SQL
    + """ SELECT id, CASE WHEN coalesce(exif_date, '') = '' THEN image_exif ELSE exif_date END AS exif_date
      FROM pairs WHERE pair = 'live' AND kind = 'video'""",
)
def live_pair_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = grouping.exact_groups(manifest(spark, sf_dir)).where("id = keeper_id")
    live = grouping.companions(files).where("pair = 'live'").select("id", "image_exif")
    own = F.nullif(F.col("exif_date"), F.lit(""))
    return files.where("kind = 'video'").join(live, "id").select("id", F.coalesce(own, "image_exif").alias("exif_date"))


def sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, h): bit i is set where component i of the embedding is over 0."""
    bits = F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    folded = F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), folded.alias("h"))


_SIGNS_SQL = """hashes AS (
  SELECT vec_id AS id, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1)
    ELSE 0 END)) AS BIGINT) + CASE WHEN embedding[64] > 0 THEN (-9223372036854775807 - 1)::BIGINT ELSE 0 END AS h
  FROM embeddings
)"""
_HASHES_SQL = f"""{_SIGNS_SQL}, nodes AS (SELECT DISTINCT h FROM hashes), edges AS (
  SELECT x.h AS a, y.h AS b, CAST(bit_count(xor(x.h, y.h)) AS INT) AS distance FROM nodes x JOIN nodes y ON x.h < y.h
  WHERE bit_count(xor(x.h, y.h)) <= {{radius}}
)"""


@_query("hamming_edges", f"WITH {_HASHES_SQL.format(radius=RADIUS)} SELECT * FROM edges")
def hamming_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hamming_links(sign_hashes(spark, sf_dir), RADIUS)


@_query("hamming_edges_wide", f"WITH {_HASHES_SQL.format(radius=WIDE)} SELECT * FROM edges")
def hamming_edges_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hamming_links(sign_hashes(spark, sf_dir), WIDE)


@_query(
    "near_dup_components",
    f"""WITH RECURSIVE {_HASHES_SQL.format(radius=WIDE)}, ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach AS (
      SELECT h AS node, h AS root FROM nodes UNION SELECT ways.b, root FROM reach JOIN ways ON ways.a = node)
    SELECT node, min(root) AS component FROM reach GROUP BY node""",
)
def near_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hamming_components(sign_hashes(spark, sf_dir), WIDE)


_MEMBERS_SQL = """members AS (SELECT id, source_path, user_id, exif_date, camera, id // 3 AS component FROM (
  SELECT doc_id AS id, 'x' AS source_path, user_id, strftime(ts, '%Y:%m:%d %H:%M:%S') AS exif_date,
    CASE WHEN doc_id % 50 = 0 THEN NULL ELSE 'cam' || (doc_id // 30) END AS camera FROM documents JOIN events ON doc_id = event_id))"""


@_query(
    "burst_or_review",
    f"""WITH {_MEMBERS_SQL}, timed AS (
      SELECT component, camera, strptime(exif_date, '%Y:%m:%d %H:%M:%S') AS t FROM members
    ), gaps AS (SELECT *, date_diff('second', lag(t) OVER (PARTITION BY component ORDER BY t), t) AS gap FROM timed)
    SELECT component, CASE WHEN count(t) = count(*) AND count(camera) = count(*) AND count(DISTINCT camera) = 1 AND max(gap) <= 60
      THEN 'burst' ELSE 'review' END AS verdict FROM gaps GROUP BY component HAVING count(*) >= 2""",
)
def burst_or_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    rows = docs.join(events, docs["doc_id"] == events["event_id"])
    camera = F.expr("IF(doc_id % 50 = 0, NULL, concat('cam', doc_id div 30))").alias("camera")
    stamp = F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("exif_date")
    members = rows.select(F.expr("doc_id div 3").alias("component"), stamp, camera)
    return grouping.burst_or_review(members, Config(max_year=2030, burst_window_s=60))


@_query(
    "resolve_date",
    f"""WITH {MANIFEST_SQL}, {_DATES_SQL} SELECT id, {_ISO.format(t="t")} AS date_taken, date_source,
      CASE date_source WHEN 'exif' THEN 'high' WHEN 'filename' THEN 'medium' WHEN 'none' THEN 'none' ELSE 'low' END AS date_confidence
    FROM dated""",
)
def resolve_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("id", dates.resolve(CFG).alias("d")).select("id", "d.*")


@_query(
    "date_parts",
    f"""WITH {MANIFEST_SQL}, {_DATES_SQL} SELECT id, {_ISO.format(t="e")} AS exif, {_ISO.format(t="f")} AS filename,
      CAST(y AS INT) AS folder, {_ISO.format(t="m")} AS mtime_date FROM dated""",
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select(
        "id",
        dates.isoformat(dates.exif_date(F.col("exif_date"), CFG)).alias("exif"),
        dates.isoformat(dates.filename_date(text.name(F.col("source_path")), CFG)).alias("filename"),
        dates.folder_year(F.col("rel_path"), CFG).alias("folder"),
        dates.isoformat(dates.mtime_date(F.col("mtime"), CFG)).alias("mtime_date"),
    )


_SLUG = (
    "coalesce(nullif(left(trim(regexp_replace(regexp_replace(regexp_extract(source_path, '[^/]*$'), '\\.[^.]+$', ''),"
    " '[^A-Za-z0-9]+', '-', 'g'), '-'), 40), ''), 'img')"
)


@_query(
    "dest_path",
    f"""WITH {MANIFEST_SQL}, {_DATES_SQL}, named AS (
      SELECT *, {_SLUG} AS slug, {_SLUG} || '_' || left(content_hash, 8) || lower(ext) AS own FROM dated)
    SELECT id, slug, '/lib/' || CASE WHEN t IS NULL THEN 'unknown-date/' || own
      WHEN date_source IN ('exif', 'filename') AND strftime(t, '%H%M%S') <> '000000' THEN strftime(t, '%Y/%m/%Y%m%d_%H%M%S_') || own
      ELSE strftime(t, '%Y/%m/%Y%m%d_') || own END AS dest_path FROM named""",
)
def dest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = manifest(spark, sf_dir).withColumn("_d", dates.resolve(CFG))
    files = files.withColumn("date_taken", F.col("_d.date_taken")).withColumn("date_source", F.col("_d.date_source"))
    return files.select("id", text.slugify(text.stem(F.col("source_path"))).alias("slug"), text.destination(CFG, "/lib").alias("dest_path"))


def _queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = manifest(spark, sf_dir).withColumn("role", F.lit("review"))
    return review.queue(files.withColumn("group_id", F.expr("id div 4")))


_QUEUE_SQL = f"""WITH {MANIFEST_SQL}, sized AS (
  SELECT *, id // 4 AS group_id, coalesce(width * height, 0) AS px FROM manifest
), queued AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY px DESC, size DESC, id) = 1 AS suggested,
    px = max(px) OVER (PARTITION BY group_id) AND px > 0 AS best_res,
    size = max(size) OVER (PARTITION BY group_id) AND size > 0 AS best_size FROM sized
), prior AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE quality WHEN 1 THEN ' Keep' ELSE 'skip' END AS decision,
    CASE WHEN quality = 1 AND toxic = 1 THEN CAST(doc_id + 1 AS VARCHAR) ELSE '' END AS merge_from_file_id FROM labels
), decided AS (
  SELECT group_id, id AS file_id, source_path, coalesce(CAST(width AS VARCHAR), 'None') || 'x' || coalesce(CAST(height AS VARCHAR), 'None')
    AS resolution, CAST(round_even(size / 1024, 0) AS BIGINT) AS size_kb, CASE WHEN suggested THEN 'keep' ELSE 'keep?' END AS suggestion,
    coalesce(decision, '') AS decision, coalesce(merge_from_file_id, '') AS merge_from_file_id
  FROM queued LEFT JOIN prior ON file_id = CAST(id AS VARCHAR)
)"""


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select(
        F.col("doc_id").alias("line"),
        F.col("doc_id").cast("string").alias("file_id"),
        F.expr("IF(quality = 1, ' Keep', 'skip')").alias("decision"),
        F.expr("IF(quality = 1 AND toxic = 1, CAST(doc_id + 1 AS STRING), '')").alias("merge_from_file_id"),
    )


@_query("review_queue", _QUEUE_SQL + " SELECT id, group_id, suggested, best_res, best_size FROM queued")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queued(spark, sf_dir).select("id", "group_id", "suggested", "best_res", "best_size")


@_query("decision_rows", _QUEUE_SQL + " SELECT * FROM decided")
def decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_rows(_queued(spark, sf_dir), review.prior_decisions(_prior(spark, sf_dir)))


@_query(
    "decision_csv_lines",
    _QUEUE_SQL
    + """ SELECT group_id, file_id, concat_ws(',', group_id, file_id, source_path, resolution, size_kb, suggestion, decision,
      merge_from_file_id) AS line FROM decided""",
)
def decision_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.csv_lines(decision_rows(spark, sf_dir))


@_query(
    "review_progress",
    _QUEUE_SQL
    + """ SELECT count(*) FILTER (WHERE d) AS decided, count(*) AS total
      FROM (SELECT bool_or(decision <> '') AS d FROM decided GROUP BY group_id)""",
)
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.progress(decision_rows(spark, sf_dir))


@_query("review_payload")
def review_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = _queued(spark, sf_dir)
    rows = review.decision_rows(queued, review.prior_decisions(_prior(spark, sf_dir)))
    shown = review.payload(queued, rows)
    return shown.select("gid", "page", text.script_safe(F.to_json("files")).alias("files"))


@_query(
    "click_fold",
    """WITH RECURSIVE files AS (SELECT doc_id // 4 AS g, doc_id AS f FROM documents),
    groups AS (SELECT g, list(f ORDER BY f) AS fs, list('' ORDER BY f) AS ds FROM files GROUP BY g),
    steps AS (
      SELECT g, f, event_type = 'click' AS donate, row_number() OVER (PARTITION BY g ORDER BY event_id) AS nth
      FROM events JOIN files ON user_id = f
    ), fold AS (
      SELECT g, fs, ds, NULL::BIGINT AS donor, 0::BIGINT AS nth FROM groups
      UNION ALL
      SELECT g, fs, CASE WHEN donate THEN ds
          WHEN d = 'keep' AND kept = 1 THEN list_transform(ds, lambda x: '')
          WHEN d = 'keep' THEN list_transform(ds, lambda x, i: CASE WHEN i = pos THEN 'skip' ELSE x END)
          ELSE list_transform(ds, lambda x, i: CASE WHEN i = pos OR x = 'keep' THEN 'keep' ELSE 'skip' END) END,
        CASE WHEN donate THEN CASE WHEN d <> 'skip' THEN donor WHEN donor = f THEN NULL ELSE f END
          WHEN d = 'keep' AND kept = 1 THEN NULL WHEN d <> 'keep' AND donor = f THEN NULL ELSE donor END, nth
      FROM (SELECT fold.g, fs, ds, donor, s.nth, s.f, donate, list_position(fs, s.f) AS pos, ds[list_position(fs, s.f)] AS d,
              len(list_filter(ds, lambda x: x = 'keep')) AS kept
            FROM fold JOIN steps s ON s.g = fold.g AND s.nth = fold.nth + 1)
    ), ended AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY nth DESC) AS last FROM fold)
    SELECT g AS group_id, unnest(fs) AS file_id, unnest(ds) AS decision, unnest(list_transform(ds, lambda d: CASE WHEN d = 'keep'
      AND ds[list_position(fs, donor)] = 'skip' THEN CAST(donor AS VARCHAR) ELSE '' END)) AS merge_from_file_id FROM ended WHERE last = 1""",
)
def click_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr("doc_id div 4").alias("group_id"), F.col("doc_id").alias("file_id"))
    files = files.select("*", F.lit("").alias("decision"), F.lit("").alias("merge_from_file_id"))
    clicks = events.select(
        F.expr("user_id div 4").alias("group_id"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("file_id"),
        F.expr("IF(event_type = 'click', 'donate', 'keep')").alias("action"),
    )
    return review.fold_clicks(files, clicks)


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = grouping.exact_groups(manifest(spark, sf_dir))
    kept = F.col("id") == F.col("keeper_id")
    role = F.when(~kept, "exact_dupe").when(F.expr("id % 3 = 0"), "review").otherwise("keep")
    files = files.withColumn("role", role).withColumn("dupe_of", F.when(~kept, F.col("keeper_id")))
    status = F.when(F.col("status") == "copied", "copied").when(F.col("role") == "review", "review").otherwise("planned")
    files = files.withColumn("status", status).withColumn("dest_path", F.concat(F.lit("/lib/"), F.col("id").cast("string")))
    return files, outcome.route(files, review.accepted_decisions(_prior(spark, sf_dir)))


_ROUTED_SQL = f"""{_KEEPERS}, planned AS (
  SELECT * REPLACE (CASE WHEN status = 'copied' THEN 'copied' WHEN nth = 1 AND id % 3 = 0 THEN 'review' ELSE 'planned' END AS status),
    CASE WHEN nth > 1 THEN 'exact_dupe' WHEN id % 3 = 0 THEN 'review' ELSE 'keep' END AS role,
    CASE WHEN nth > 1 THEN keeper_id END AS dupe_of FROM ranked
), routed AS (
  SELECT p.*, CASE WHEN role = 'exact_dupe' THEN 'skip_dupe' WHEN role = 'review' AND l.doc_id IS NULL THEN 'held'
      WHEN role = 'review' AND quality = 0 THEN 'skip_manual' ELSE 'copy' END AS action,
    CASE WHEN role = 'review' AND quality = 1 AND toxic = 1 THEN p.id + 1 END AS merge_from
  FROM planned p LEFT JOIN labels l ON l.doc_id = p.id WHERE status IN ('planned', 'review')
)"""


@_query("apply_routing", _ROUTED_SQL + " SELECT id, action, merge_from FROM routed")
def apply_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)[1].select("id", "action", "merge_from")


@_query(
    "apply_counts",
    _ROUTED_SQL
    + """ SELECT count(*) FILTER (WHERE action = 'copy') AS copied, count(*) FILTER (WHERE action LIKE 'skip%') AS skipped,
      count(*) FILTER (WHERE action = 'held') AS held FROM routed""",
)
def apply_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.outcome_counts(_routed(spark, sf_dir)[1])


@_query(
    "merge_jobs",
    _ROUTED_SQL
    + """ SELECT r.id AS keeper_id, p.id AS donor_id, p.source_path AS donor_path, '/lib/' || r.id AS keeper_dest
      FROM routed r JOIN planned p ON p.id = r.merge_from WHERE action = 'copy'""",
)
def merge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, routed = _routed(spark, sf_dir)
    return outcome.merge_jobs(routed, files)


@_query(
    "metadata_fill",
    _ROUTED_SQL
    + """ SELECT r.id AS keeper_id, coalesce(r.exif_date, p.exif_date) AS exif_date, coalesce(r.camera, p.camera) AS camera
      FROM routed r JOIN planned p ON p.id = r.merge_from WHERE action = 'copy'""",
)
def metadata_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, routed = _routed(spark, sf_dir)
    return outcome.fill_metadata(files, outcome.merge_jobs(routed, files), ("exif_date", "camera"))


_PROVENANCE_SQL = f"""{_ROUTED_SQL}, rels AS (
  SELECT id, -1 AS nth_copy, rel_path AS rel FROM routed WHERE action = 'copy'
  UNION ALL SELECT p.dupe_of, p.id, p.rel_path FROM planned p JOIN routed r ON r.id = p.dupe_of AND r.action = 'copy'
), told AS (
  SELECT id, 'source: ' || string_agg(rel, ' | ' ORDER BY nth_copy) AS description,
    list_sort(list_distinct(flatten(list(string_split(rel, '/')[:-2]))))[:12] AS words FROM rels GROUP BY id
)"""


@_query("provenance", _PROVENANCE_SQL + " SELECT id, array_to_string(words, ';') AS keywords, description FROM told")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, routed = _routed(spark, sf_dir)
    told = outcome.provenance(routed.where("action = 'copy'"), files, CFG)
    return told.select("id", F.array_join("keywords", ";").alias("keywords"), "description")


def _escaped_sql(value: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        value = f"replace({value}, '{char}', '{entity}')"
    return value


@_query(
    "xmp_sidecar",
    f"""{_PROVENANCE_SQL} SELECT id, '<?xpacket begin="' || chr(65279) || '" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/">
 <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
  <rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/">
   <dc:description><rdf:Alt><rdf:li xml:lang="x-default">' || {_escaped_sql("description")} || '</rdf:li></rdf:Alt></dc:description>
   <dc:subject><rdf:Bag>' || array_to_string(list_transform(words, lambda w: '<rdf:li>' || {_escaped_sql("w")} || '</rdf:li>'), '')
      || '</rdf:Bag></dc:subject>
  </rdf:Description>
 </rdf:RDF>
</x:xmpmeta>
<?xpacket end="w"?>' AS xmp FROM told""",
)
def xmp_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, routed = _routed(spark, sf_dir)
    told = outcome.provenance(routed.where("action = 'copy'"), files, CFG)
    return told.select("id", outcome.sidecar(F.col("description"), F.col("keywords")).alias("xmp"))


@_query("blake2_hash")
def blake2_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", blake2b_column("text").alias("content_hash"))


#: A plan in SQL; the dates come last, as a live pair's video takes its image's.
_PLAN_SQL = f"""{_PAIRS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, {_SIGNS_SQL}, images AS (
  SELECT r.id, h FROM ranked r JOIN hashes s ON r.id = s.id WHERE nth = 1 AND kind = 'image'
), nodes AS (SELECT DISTINCT h FROM images), ways AS (
  SELECT x.h AS a, y.h AS b FROM nodes x JOIN nodes y ON x.h <> y.h WHERE bit_count(xor(x.h, y.h)) <= {WIDE}
), reach AS (
  SELECT h AS node, h AS root FROM nodes UNION SELECT ways.b, root FROM reach JOIN ways ON ways.a = node
), lookalike AS (
  SELECT id, component FROM images JOIN (SELECT node, min(root) AS component FROM reach GROUP BY node) ON node = h
  WHERE id NOT IN (SELECT id FROM pairs)
), timed AS (
  SELECT component, s.id, camera, try_cast(regexp_replace(exif_date, '(\\d+):(\\d+):(\\d+) (.*)', '\\1-\\2-\\3 \\4') AS TIMESTAMP) AS t
  FROM lookalike s JOIN ranked r ON r.id = s.id
), gaps AS (
  SELECT *, date_diff('second', lag(t) OVER (PARTITION BY component ORDER BY t), t) AS gap FROM timed
), judged AS (
  SELECT component, CASE WHEN count(t) = count(*) AND count(camera) = count(*) AND count(DISTINCT camera) = 1 AND max(gap) <= 10
    THEN 'burst' ELSE 'review' END AS verdict FROM gaps GROUP BY component HAVING count(*) >= 2
), told AS (
  SELECT r.* REPLACE (CASE WHEN p.pair = 'live' AND r.kind = 'video' AND coalesce(r.exif_date, '') = '' THEN p.image_exif
      ELSE r.exif_date END AS exif_date), p.pair_key, s.component,
    CASE WHEN verdict IS NOT NULL THEN verdict WHEN p.pair = 'raw' THEN 'raw_jpeg_pair' WHEN p.pair = 'live' AND r.kind = 'video'
      THEN 'live_pair' WHEN nth = 1 THEN 'keep' ELSE 'exact_dupe' END AS role
  FROM ranked r LEFT JOIN pairs p ON p.id = r.id LEFT JOIN lookalike s ON s.id = r.id LEFT JOIN judged j ON j.component = s.component
), {_DATES_SQL.replace("FROM manifest", "FROM told")}"""


@_query(
    "library_plan",
    f"""{_PLAN_SQL} SELECT id, role, CASE WHEN nth > 1 THEN keeper_id END AS dupe_of,
      CASE WHEN status = 'copied' THEN 'copied' WHEN role = 'review' THEN 'review' ELSE 'planned' END AS status,
      {_ISO.format(t="t")} AS date_taken, date_source,
      CASE date_source WHEN 'exif' THEN 'high' WHEN 'filename' THEN 'medium' WHEN 'none' THEN 'none' ELSE 'low' END AS date_confidence,
      exif_date FROM dated""",
)
def library_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole plan of the derived manifest, with perceptual hashes where there are embeddings."""
    planned = _planned(spark, sf_dir)
    return planned.select("id", "role", "dupe_of", "status", "date_taken", "date_source", "date_confidence", "exif_date")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = sign_hashes(spark, sf_dir).select("id", F.lpad(F.lower(F.hex("h")), 16, "0").alias("_ph"))
    files = manifest(spark, sf_dir).join(hashes, "id", "left").withColumn("phash", F.col("_ph")).drop("_ph")
    cfg = Config(max_year=2030, near_dupe_threshold=WIDE)
    return plan(files, cfg)


@_query(
    "plan_counts",
    f"""{_PLAN_SQL} SELECT count(*) FILTER (WHERE role = 'exact_dupe') AS exact_dupes,
      count(DISTINCT pair_key) FILTER (WHERE role = 'raw_jpeg_pair') AS raw_pairs,
      count(DISTINCT component) FILTER (WHERE role = 'burst') AS bursts,
      count(DISTINCT component) FILTER (WHERE role = 'review') AS review_groups FROM told""",
)
def plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.plan_counts(_planned(spark, sf_dir))


@_query("group_numbers", _PAIRS_SQL + " SELECT pair_key, 7 + row_number() OVER (ORDER BY pair_key) AS number FROM (SELECT DISTINCT pair_key FROM pairs)")
def group_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(companion_groups(spark, sf_dir).select("pair_key").distinct(), "pair_key", "number", 7)


@_query(
    "metadata_upsert",
    f"""WITH {MANIFEST_SQL}, read AS (
      SELECT id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '2016:01:02 03:04:05' END AS a,
        CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN '2017:01:02 03:04:05' END AS b, '2018:01:02 03:04:05' AS c FROM manifest WHERE id % 6 < 5)
    SELECT m.id, CASE WHEN r.id IS NULL THEN exif_date ELSE coalesce(nullif(a, ''), nullif(b, ''), c) END AS exif_date,
      CASE WHEN r.id IS NULL THEN camera ELSE 'M' || (m.id % 3) END AS camera,
      CASE WHEN r.id IS NULL THEN width ELSE m.id % 5000 END AS width, CASE WHEN r.id IS NULL THEN height END AS height
    FROM manifest m LEFT JOIN read r ON r.id = m.id""",
)
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = manifest(spark, sf_dir)
    records = files.where("id % 6 < 5").select(
        "source_path",
        F.expr("CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '2016:01:02 03:04:05' END").alias("DateTimeOriginal"),
        F.expr("CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN '2017:01:02 03:04:05' END").alias("CreateDate"),
        F.lit("2018:01:02 03:04:05").alias("MediaCreateDate"),
        F.expr("concat('M', id % 3)").alias("Model"),
        F.expr("CAST(id % 5000 AS STRING)").alias("ImageWidth"),
        F.lit(None).cast("string").alias("ImageHeight"),
    )
    merged = incremental.with_metadata(files, records)
    return merged.select("id", "exif_date", "camera", F.col("width").cast("long"), F.col("height").cast("long"))


@_query(
    "decision_overlay",
    """WITH saved AS (
      SELECT doc_id AS file_id, doc_id // 4 AS group_id, CASE quality WHEN 1 THEN 'KEEP' ELSE 'maybe' END AS decision FROM labels
    ), unsaved AS (
      SELECT event_id AS file_id, CASE event_type WHEN 'click' THEN 'keep' WHEN 'view' THEN 'Skip' ELSE '' END AS decision FROM events WHERE event_id % 2 = 0)
    SELECT group_id, s.file_id, CASE WHEN u.file_id IS NOT NULL THEN lower(u.decision) WHEN s.decision = 'KEEP' THEN 'keep' ELSE '' END AS decision
    FROM saved s LEFT JOIN unsaved u ON s.file_id = u.file_id""",
)
def decision_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    saved = labels.select(F.col("doc_id").alias("file_id"), F.expr("doc_id div 4").alias("group_id"), F.expr("IF(quality = 1, 'KEEP', 'maybe')").alias("decision"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 2 = 0")
    decision = F.expr("CASE event_type WHEN 'click' THEN 'keep' WHEN 'view' THEN 'Skip' ELSE '' END")
    return review.overlay(saved, events.select(F.col("event_id").alias("file_id"), decision.alias("decision")))


@_query(
    "embed_arguments",
    _PROVENANCE_SQL
    + """ SELECT id, concat_ws(chr(10), '-overwrite_original', '-XMP-dc:Description=' || description,
      array_to_string(list_transform(words, lambda w: '-XMP-dc:Subject=' || w), chr(10)), '/lib/' || id, '-execute') AS arguments FROM told""",
)
def embed_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, routed = _routed(spark, sf_dir)
    told = outcome.provenance(routed.where("action = 'copy'"), files, CFG)
    dest = F.concat(F.lit("/lib/"), F.col("id").cast("string"))
    return told.select("id", F.array_join(outcome.embed_arguments(dest, F.col("description"), F.col("keywords")), "\n").alias("arguments"))


@_query(
    "display_labels",
    f"""WITH {MANIFEST_SQL} SELECT id, 'file://' || replace(url_encode(source_path), '%2F', '/') AS uri,
      CASE WHEN size * 997 >= 1048576 THEN printf('%.1f MB', size * 997 / 1048576) ELSE CAST(CAST(round(size * 997 / 1024) AS BIGINT) AS VARCHAR) || ' KB' END AS size,
      CASE WHEN width > 0 AND height > 0 THEN printf('%.1f MP', CAST(width AS DOUBLE) * height / 1000000) ELSE '? MP' END AS pixels FROM manifest""",
)
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select(
        "id",
        text.file_uri(F.col("source_path")).alias("uri"),
        text.size_label(F.col("size") * 997).alias("size"),
        text.megapixel_label(F.col("width"), F.col("height")).alias("pixels"),
    )


@_query(
    "review_payload_files",
    _QUEUE_SQL
    + """ SELECT q.group_id AS gid, CAST(row_number() OVER (PARTITION BY q.group_id ORDER BY size DESC, q.id) - 1 AS INT) AS place, q.id,
      q.source_path AS path, width AS w, height AS h, size, ext, kind, camera, suggested, best_res AS "bestRes", best_size AS "bestSize",
      resolution, size_kb, suggestion, decision, merge_from_file_id AS merge
    FROM queued q JOIN decided d ON d.file_id = q.id""",
)
def review_payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = _queued(spark, sf_dir)
    shown = review.payload(queued, review.decision_rows(queued, review.prior_decisions(_prior(spark, sf_dir))))
    files = shown.select("gid", "page", F.posexplode("files").alias("at", "f"))
    files = files.select("gid", (F.col("page") * review.PAGE + F.col("at")).cast("int").alias("place"), "f")
    own = ("id", "path", "w", "h", "size", "ext", "kind", "camera", "suggested", "bestRes", "bestSize", "decision", "merge")
    return files.select("gid", "place", *(F.col(f"f.{c}").alias(c) for c in own), "f.csv.*")


_ROOTS = ("/photos", "/photos more", "/old.photos")
_NAMES = ("a", "a b", "a.b", "a-b", "a/b", "A", "a!", "é", "ab")


@_query(
    "walk_order",
    f"""WITH paths AS (
      SELECT doc_id % 3 AS position, {_sql_list(_ROOTS)}[doc_id % 3 + 1] || '/' || {_sql_list(_NAMES)}[doc_id // 3 % 9 + 1] || '/'
        || {_sql_list(_NAMES)}[doc_id // 27 % 9 + 1] || '/' || doc_id || '.jpg' AS source_path FROM documents)
    SELECT source_path, row_number() OVER (ORDER BY position, string_split(source_path, '/')) AS id FROM paths""",
)
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of new files: by root, then by the parts of their paths."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    parts = (_pick(_ROOTS, "doc_id % 3"), _pick(_NAMES, "doc_id div 3 % 9"), _pick(_NAMES, "doc_id div 27 % 9"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))
    paths = docs.select(F.expr("CAST(doc_id % 3 AS INT)").alias("root_position"), F.concat_ws("/", *parts).alias("source_path"))
    return numbered(paths, incremental.walk_key(paths), "id").select("source_path", "id")


@_query(
    "scan_audit",
    f"""WITH {MANIFEST_SQL}, {_WALKED_SQL}, added AS (
      SELECT source_path, (SELECT max(id) FROM manifest) + row_number() OVER (ORDER BY string_split(source_path, '/')) AS id
      FROM changed WHERE source_path NOT IN (SELECT source_path FROM manifest))
    SELECT coalesce(m.id, a.id) AS file_id, 'scanned' AS action, c.source_path AS detail
    FROM changed c LEFT JOIN manifest m USING (source_path) LEFT JOIN added a USING (source_path)""",
)
def scan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan writes to the action log: the ids of all new and changed files."""
    files = manifest(spark, sf_dir)
    changed = incremental.changed_files(_walked(files), files)
    return incremental.scanned(incremental.upsert(files, changed), changed)


@_query(
    "plan_detail",
    f"""{_PLAN_SQL} SELECT 'exact_dupes=' || count(*) FILTER (WHERE role = 'exact_dupe')
      || ' raw_pairs=' || count(DISTINCT pair_key) FILTER (WHERE role = 'raw_jpeg_pair')
      || ' bursts=' || count(DISTINCT component) FILTER (WHERE role = 'burst')
      || ' review_groups=' || count(DISTINCT component) FILTER (WHERE role = 'review') AS detail FROM told""",
)
def plan_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan writes to the action log."""
    return summary.plan_detail(summary.plan_counts(_planned(spark, sf_dir)))


@_query(
    "apply_log",
    f"""{_ROUTED_SQL}, {_DATES_SQL.replace("FROM manifest", "FROM routed")}
    SELECT id AS file_id, CASE action WHEN 'skip_dupe' THEN 'skipped_exact_dupe' WHEN 'skip_manual' THEN 'skipped_manual_review' ELSE 'copied' END
        AS action,
      CASE action WHEN 'skip_dupe' THEN 'dupe_of=' || dupe_of WHEN 'skip_manual' THEN ''
        ELSE source_path || ' -> /lib/' || id || ' (date:' || date_source || '/' || CASE date_source WHEN 'exif' THEN 'high'
          WHEN 'filename' THEN 'medium' WHEN 'none' THEN 'none' ELSE 'low' END || ', role:' || role || ')' END AS detail
    FROM dated WHERE action <> 'held'""",
)
def apply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applying a plan writes to the action log."""
    _, routed = _routed(spark, sf_dir)
    found = dates.resolve(CFG)
    routed = routed.withColumns({c: found[c] for c in ("date_source", "date_confidence")})
    return outcome.actions(routed, 1, "").select("file_id", "action", "detail")


@_query(
    "group_numbers_after",
    _PAIRS_SQL
    + """ SELECT pair_key, (SELECT coalesce(max(id // 3), 0) FROM manifest WHERE id % 7 = 2) + row_number() OVER (ORDER BY pair_key) AS number
      FROM (SELECT DISTINCT pair_key FROM pairs)""",
)
def group_numbers_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of groups after those of the files that a new plan leaves as they are."""
    files = manifest(spark, sf_dir).withColumn("group_id", F.expr("id div 3"))
    files = files.withColumn("status", F.expr("IF(id % 7 = 2, IF(id % 2 = 0, 'error', 'skipped_manual'), status)"))
    pairs = companion_groups(spark, sf_dir).select("pair_key").distinct()
    return numbered(pairs, "pair_key", "number", last_group(reset(files)))


@_query(
    "perceptual_hashes",
    """WITH cells AS (
      SELECT vec_id, embedding[8 * i + j + 1] AS x, i, j FROM embeddings, range(8) r(i), range(8) c(j) WHERE len(embedding) = 64
    ), frequencies AS (
      SELECT vec_id, 8 * u + v AS place, sum(4 * x * cos(pi() * u * (2 * i + 1) / 16) * cos(pi() * v * (2 * j + 1) / 16)) AS f
      FROM cells, range(8) a(u), range(8) b(v) GROUP BY vec_id, u, v
    ), bits AS (SELECT vec_id, place, f > median(f) OVER (PARTITION BY vec_id) AS bit FROM frequencies),
    quads AS (SELECT vec_id, place // 4 AS q, sum(CASE WHEN bit THEN 8 >> (place % 4)::INT ELSE 0 END)::INT AS digit FROM bits GROUP BY vec_id, place // 4)
    SELECT vec_id, string_agg('0123456789abcdef'[digit + 1], '' ORDER BY q) AS phash FROM quads GROUP BY vec_id""",
)
def perceptual_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of embeddings, each taken for a picture of 8 by 8 grey values."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select("vec_id", phash.hash_column(F.col("embedding"), 8).alias("phash"))


@_query(
    "pending_images",
    f"""WITH {MANIFEST_SQL} SELECT id, source_path FROM manifest LEFT JOIN embeddings ON vec_id = id
    WHERE kind = 'image' AND status = 'scanned' AND (embedding IS NULL OR id % 5 = 0)""",
)
def pending_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images that still have no perceptual hash; others have that of their embedding, but for some that weren't decoded."""
    hashes = perceptual_hashes(spark, sf_dir).where("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"), F.col("phash").alias("_ph"))
    files = manifest(spark, sf_dir).join(hashes, "id", "left").withColumn("phash", F.col("_ph")).drop("_ph")
    return sources.pending_images(files).select("id", "source_path")


@_query(
    "provenance_ways",
    _ROUTED_SQL
    + """ SELECT id, CASE WHEN ext IN ('.jpg', '.jpeg', '.png', '.heic') THEN 'embedded' ELSE 'sidecar' END AS way FROM routed WHERE action = 'copy'""",
)
def provenance_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _routed(spark, sf_dir)[1].where("action = 'copy'")
    return routed.select("id", outcome.way(F.col("ext"), CFG).alias("way"))


@_query(
    "dry_run",
    f"""{_ROUTED_SQL}, {_DATES_SQL.replace("FROM manifest", "FROM routed")}, named AS (
      SELECT *, {_SLUG} || '_' || left(content_hash, 8) || lower(ext) AS own FROM dated)
    SELECT action, source_path, '/out/' || CASE WHEN action <> 'copy' THEN NULL WHEN t IS NULL THEN 'unknown-date/' || own
      WHEN date_source IN ('exif', 'filename') AND strftime(t, '%H%M%S') <> '000000' THEN strftime(t, '%Y/%m/%Y%m%d_%H%M%S_') || own
      ELSE strftime(t, '%Y/%m/%Y%m%d_') || own END AS dest_path FROM named""",
)
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applying a plan would do with every planned and queued file."""
    routed = _routed(spark, sf_dir)[1].withColumn("_d", dates.resolve(CFG)).withColumn("dest_path", F.lit(None).cast("string"))
    routed = routed.withColumns({c: F.col(f"_d.{c}") for c in ("date_taken", "date_source")})
    return outcome.with_destinations(routed, CFG, "/out").select("action", "source_path", "dest_path")


@_query("review_export", _QUEUE_SQL + " SELECT count(DISTINCT group_id) AS groups, count(*) AS files FROM decided")
def review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.exported(decision_rows(spark, sf_dir))


@_query(
    "applied_manifest",
    _ROUTED_SQL
    + """ SELECT p.id, CASE r.action WHEN 'copy' THEN 'copied' WHEN 'skip_dupe' THEN 'skipped_dupe' WHEN 'skip_manual' THEN 'skipped_manual'
      ELSE p.status END AS status, '/lib/' || p.id AS dest_path FROM planned p LEFT JOIN routed r ON r.id = p.id""",
)
def applied_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after a plan was applied."""
    files, routed = _routed(spark, sf_dir)
    return outcome.applied(files, routed).select("id", "status", "dest_path")


@_query(
    "action_json_lines",
    f"""{_ROUTED_SQL} SELECT id AS file_id, json_object('ts', '2024-01-02T03:04:05', 'run', 12, 'file_id', id, 'action',
        CASE action WHEN 'skip_dupe' THEN 'skipped_exact_dupe' WHEN 'skip_manual' THEN 'skipped_manual_review' ELSE 'copied' END, 'detail',
        CASE action WHEN 'skip_dupe' THEN 'dupe_of=' || dupe_of WHEN 'skip_manual' THEN ''
        ELSE source_path || ' -> /lib/' || id || ' (date:"a"/low, role:' || role || ')' END)::VARCHAR AS line FROM routed WHERE action <> 'held'""",
)
def action_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the action log as JSON."""
    routed = _routed(spark, sf_dir)[1].withColumns({"date_source": F.lit('"a"'), "date_confidence": F.lit("low")})
    fields = outcome.log_lines(outcome.actions(routed, 12, "2024-01-02T03:04:05"))
    return fields.select("file_id", F.to_json(F.struct(*fields.columns)).alias("line"))


@_query(
    "script_safe_json",
    f"""WITH {MANIFEST_SQL} SELECT id, replace(json_object('path', source_path || '</script>', 'name', 'a "b" </' || ext)::VARCHAR, '</', '<\\/') AS json
    FROM manifest""",
)
def script_safe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with what would end a script element, made safe."""
    path, name = F.concat("source_path", F.lit("</script>")).alias("path"), F.concat(F.lit('a "b" </'), "ext").alias("name")
    return manifest(spark, sf_dir).select("id", text.script_safe(F.to_json(F.struct(path, name))).alias("json"))
