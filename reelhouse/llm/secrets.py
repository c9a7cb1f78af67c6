"""Secret scan with multipart credential linking, in DataFrame functions only.

Base findings (assignments, access identifiers, hexadecimal strings) are reported as they are.
Weak candidates (identifiers, secrets and endpoints that alone say little) are reported only
where complementary parts co-occur within the same scope, however far apart: a stretch of text without a blank line
and without a border between two objects in braces. The join of the parts' intervals is a sweep: two windows over a
document's parts, in the order of their starts and in reverse, give each part the nearest end
before it and the nearest start after it of every kind in its scope. No pairs are made, so the work is
n log n in a document's parts.

A document is one row until its parts are exploded; all that follows is dealt by row, in one
shuffle that carries a few numbers for each part and never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT, BREAK = range(7)
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: One pattern a kind; group 1 is the value that must be long enough. Runs of hexadecimal digits are
#: matched from 24 on at once: a match of ``[0-9a-f]+`` is a whole run, so the long ones are the same.
PATTERNS = {
    ASSIGN: r"(?i:password|passwd|secret|token|api_?key)" + _VALUE + r"([A-Za-z0-9+/_.=-]+)",
    ACCESS: r"(AKIA[A-Z0-9]+)",
    HEX: r"([0-9a-f]{24,})",
    IDENTIFIER: r"(?i:access[_-]?key[_-]?id|client[_-]?id|tenant[_-]?id|account|user[_-]?name|user|login)"
    + _VALUE
    + r"([A-Za-z0-9@+/_.-]+)",
    SECRET: r"(?i:private[_-]?key|client[_-]?key|access[_-]?key|pass|pwd|credential|bearer|signature)"
    + r"""["']?\x20*[:=]\x20*"""
    # A block between BEGIN and END, or what is quoted, is taken whole.
    + r"""(["']?-----BEGIN [A-Z ]+-----[^-]*-----END [A-Z ]+-----|"[^"\n]{6,}"|'[^'\n]{6,}'|["']?[A-Za-z0-9+/_.=~-]+)""",
    ENDPOINT: r"""(?i:https?|ftps?|sftp|ssh|jdbc|mongodb|postgres|postgresql|mysql|redis|amqp|s3)://([^\x00-\x20"'<>]+)""",
    BREAK: r"(\n[\x20\t\r]*\n|\}[\x20\t\r\n,]*\{)",
}
LEAST = {ASSIGN: 6, ACCESS: 20, HEX: 24, IDENTIFIER: 3, SECRET: 6, ENDPOINT: 4, BREAK: 1}
#: A text without any of these substrings has no match of the kind.
_NEEDS = {ASSIGN: (":", "="), ACCESS: ("AKIA",), IDENTIFIER: (":", "="), SECRET: (":", "="), ENDPOINT: ("://",)}


def _matches(text: Column, kind: int) -> Column:
    """An array with a struct for each match: the lengths of what lies before it, of it and of its value.

    What lies before: since the match before. Java's split and the extraction walk through the
    same matches, leftmost and not overlapping.
    """
    pattern = F.lit(PATTERNS[kind])
    found = F.arrays_zip(
        F.split(text, PATTERNS[kind], -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("value"),
    )
    lengths = F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(m["gap"]).alias("gap"),
            F.length(m["match"]).alias("n"),
            F.length(m["value"]).alias("value"),
        ),
    )
    any_of = text.rlike(PATTERNS[kind])
    if kind in _NEEDS:
        present = F.lit(False)
        for part in _NEEDS[kind]:
            present = present | F.contains(text, F.lit(part))
        any_of = present & any_of
    # The last gap is what lies after the last match.
    return F.when(any_of, F.filter(lengths, lambda m: m["n"].isNotNull()))


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, kind, start, end): the valid parts of each input row and its scopes' borders, or one row without kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    kinds = [_matches(F.col("text"), k) for k in range(BREAK)]
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,value:int>>")
    rows = rows.select("row", "id", "text", F.concat(*(F.coalesce(k, empty) for k in kinds)).alias("found"))
    weak = F.exists("found", lambda m: m["kind"] >= IDENTIFIER)
    breaks = F.when(weak, F.coalesce(_matches(F.col("text"), BREAK), empty)).otherwise(empty)
    rows = rows.select("row", "id", F.explode_outer(F.concat("found", breaks)).alias("m")).select("row", "id", "m.*")
    rows = rows.repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("n")).over(order))
    rows = rows.withColumn("start", F.col("end") - F.col("n"))
    least = F.lit(None)
    for kind, n in LEAST.items():
        least = F.when(F.col("kind") == kind, F.lit(n)).otherwise(least)
    dropped = F.col("value") < least
    # A row whose matches are all dropped must not vanish: its first match stays, without kind.
    kind = F.when(~dropped, F.col("kind"))
    rows = rows.where(F.col("kind").isNull() | ~dropped | (F.col("i") == 0))
    return rows.select("row", "id", kind.alias("kind"), "start", "end")


def linked(found: DataFrame) -> DataFrame:
    """``parts`` with ``reported``: base findings, and weak ones with complementary parts in their scope."""
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    scope = F.count(F.when(F.col("kind") == BREAK, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("scope", scope)
    kind = F.col("kind")
    groups = {
        "base": kind <= HEX,
        "strong_id": kind == ACCESS,
        "any_id": kind.isin(ACCESS, IDENTIFIER),
        "strong_secret": kind.isin(ASSIGN, HEX),
        "any_secret": kind.isin(ASSIGN, HEX, SECRET),
        "endpoint": kind == ENDPOINT,
    }
    before = Window.partitionBy("row", "scope").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = (
        Window.partitionBy("row", "scope")
        .orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for name, member in groups.items():
        found = found.withColumn(f"{name}_before", F.max(F.when(member, F.col("end"))).over(before))
    for name, member in groups.items():
        found = found.withColumn(f"{name}_after", F.min(F.when(member, F.col("start"))).over(after))

    def near(name: str) -> Column:
        return F.col(f"{name}_before").isNotNull() | F.col(f"{name}_after").isNotNull()

    covered = F.coalesce(F.col("base_before") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("base_after") < F.col("end"), F.lit(False)
    )
    reported = (
        F.when(kind <= HEX, True)
        .when(covered, False)
        .when(kind == IDENTIFIER, near("strong_secret") | (near("any_secret") & near("endpoint")))
        .when(kind == SECRET, near("strong_id") | (near("any_id") & near("endpoint")))
        .when(kind == ENDPOINT, near("any_id") & near("any_secret"))
        .otherwise(False)
    )
    return found.select("row", "id", "kind", "start", "end", reported.alias("reported"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, findings array of (start, kind, end)), one row per input row, by start and then kind.

    Offsets are code points of the whole text, the end exclusive; ``kind`` is a number in ``KINDS``.
    A null text counts as empty and has no findings. Null and repeated ids keep their rows, each
    judged alone. An empty table gives an empty result. Other columns aren't read.
    """
    found = linked(parts(docs, id_col, text_col))
    span = F.struct("start", "kind", "end")
    return (
        found.groupBy("row")
        .agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.when(F.col("reported"), span))).alias("findings"))
        .select(F.col("id").alias(id_col), "findings")
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.read(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda s: s["kind"] <= HEX)

    def n(kind: int) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        n(ASSIGN).alias("n_assign"),
        n(ACCESS).alias("n_access"),
        n(HEX).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("findings")).alias("spans"),
    )


def _sql() -> str:
    quoted = {k: "'" + p.replace("'", "''") + "'" for k, p in PATTERNS.items()}
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, {LEAST[k]} AS least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v,"
        f" unnest(g[1:len(m)]) AS g FROM (SELECT r, regexp_extract_all(text, {p}, 0) AS m,"
        f" regexp_extract_all(text, {p}, 1) AS v, string_split_regex(text, {p}) AS g FROM d)"
        for k, p in quoted.items()
    )
    groups = {
        "base": f"kind <= {HEX}",
        "strong_id": f"kind = {ACCESS}",
        "any_id": f"kind IN ({ACCESS}, {IDENTIFIER})",
        "strong_secret": f"kind IN ({ASSIGN}, {HEX})",
        "any_secret": f"kind IN ({ASSIGN}, {HEX}, {SECRET})",
        "endpoint": f"kind = {ENDPOINT}",
    }
    near = {
        g: f"({g}_before IS NOT NULL OR {g}_after IS NOT NULL)" for g in groups
    }
    names = ", ".join(f"'{k}'" for k in KINDS)
    listed = "string_agg(list_value({names})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e)".replace(
        "{names}", names
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
placed AS (
  SELECT r, kind, e - length(m) AS s, e FROM (
    SELECT r, kind, least, m, v, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS e
    FROM found) WHERE length(v) >= least
), scoped AS (
  SELECT *, count(CASE WHEN kind = {BREAK} THEN 1 END) OVER
    (PARTITION BY r ORDER BY s, kind, e ROWS UNBOUNDED PRECEDING) AS scope FROM placed
), swept AS (
  SELECT *, {', '.join(f'max(CASE WHEN {c} THEN e END) OVER b AS {g}_before, min(CASE WHEN {c} THEN s END) OVER a AS {g}_after' for g, c in groups.items())}
  FROM scoped
  WINDOW b AS (PARTITION BY r, scope ORDER BY s, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY r, scope ORDER BY s DESC, kind DESC, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), reported AS (
  SELECT r, kind, s, e FROM swept WHERE CASE
    WHEN kind <= {HEX} THEN true
    WHEN coalesce(base_before > s, false) OR coalesce(base_after < e, false) THEN false
    WHEN kind = {IDENTIFIER} THEN {near['strong_secret']} OR ({near['any_secret']} AND {near['endpoint']})
    WHEN kind = {SECRET} THEN {near['strong_id']} OR ({near['any_id']} AND {near['endpoint']})
    WHEN kind = {ENDPOINT} THEN {near['any_id']} AND {near['any_secret']}
    ELSE false END
), texts AS (
  SELECT r, count(CASE WHEN kind = {ASSIGN} THEN 1 END) AS a, count(CASE WHEN kind = {ACCESS} THEN 1 END) AS k,
    count(CASE WHEN kind = {HEX} THEN 1 END) AS h, {listed} AS spans,
    {listed} FILTER (WHERE kind <= {HEX}) AS base
  FROM reported GROUP BY r
)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access,
  CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (r)
"""


OP3_SQL = _sql()
