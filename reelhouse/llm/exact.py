"""Exact deduplication by recipes of content-defined chunks, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. A text is cut into chunks where its content
says so: at the first line feed or end of a sentence after ``LEAST`` characters, after ``MOST`` at the latest,
so equal texts have equal chunks, and passages that texts share mostly become the same chunks. A document's
recipe is the list of its chunks' 64-bit hashes.

1. Every row's recipe and digest are written; no text is.
2. The chunks are deduplicated, first within a task and then by one shuffle, in which the text of a chunk moves
   once for each task that has it. A hash that belongs to one text only is a verified identifier.
   Where several texts share a hash, chunks with it are named by their own text instead (``_named``).
3. Recipes, now lists of verified identifiers, are grouped and compared as a whole. What meets in a group is
   counted before the shuffle; what each row learns of its group comes by a join that adaptive execution can
   split, so copies that are a third of all rows are no one task's work.

Long texts are moved at most once, as chunks, and never compared as a whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of a chunk.
LEAST, MOST = 512, 8192


def normalised(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order, an array without elements for the empty text. End to end they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?[\n.!?]|.{{1,{most}}}"), F.lit(0))


def _hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, t): ``row`` tells rows apart, also those with equal ids or none; once it is written it stays the same."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))


def recipes(rows: DataFrame) -> DataFrame:
    """(row, id, sha, recipe) of each of ``rows`` (row, id, t)."""
    return rows.select("row", "id", F.sha2("t", 256).alias("sha"), F.transform(chunks(F.col("t")), _hash).alias("recipe"))


def shared_hashes(rows: DataFrame) -> DataFrame:
    """(h): hashes that chunks of different texts share; every other hash is a verified identifier."""
    chunk = rows.select(F.explode(chunks(F.col("t"))).alias("chunk"))
    texts = chunk.select(_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    return texts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


_SPELLED = "array<struct<place:int,chunk:string>>"


def _named(rows: DataFrame, recipe: DataFrame, shared: DataFrame) -> DataFrame:
    """``recipe`` with ``spelled``: the text and place of each chunk whose hash isn't an identifier."""
    chunk = rows.select("row", F.posexplode(chunks(F.col("t"))).alias("place", "chunk")).withColumn("h", _hash(F.col("chunk")))
    chunk = chunk.join(shared, "h", "left_semi")
    spelled = chunk.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "chunk"))).alias("spelled"))  # a part of one document
    return recipe.join(spelled, "row", "left")


def _grouped(rows: DataFrame) -> DataFrame:
    recipe = common.checkpoint(recipes(rows))
    shared = common.checkpoint(shared_hashes(rows))
    none = F.array().cast(_SPELLED)
    if shared.isEmpty():
        recipe = recipe.withColumn("spelled", none)
    else:
        rows = common.checkpoint(rows)
        recipe = common.checkpoint(_named(rows, recipes(rows), shared).withColumn("spelled", F.coalesce("spelled", none)))
    found = recipe.groupBy("recipe", "spelled").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size"))
    # Written first, so that both sides of the join are dealt anew and large partitions can be split.
    found = common.checkpoint(found.select("recipe", "spelled", F.col("last.id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"))
    joined = recipe.join(found, ["recipe", "spelled"])
    return joined.select("row", "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, keep_id, group_size, kept, sha) of each input row.

    Of equal texts the row with the largest id is kept. A null id comes before all others; of rows that
    share the largest id one is kept. Null and empty texts are equal. No rows give no rows.
    """
    return _grouped(_rows(docs, id_col, text_col))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever those are called.

    The rows are written with a number first, as those of a plan that is run twice may come in another order.
    """
    name = common.spare_name(docs, "_row")
    written = common.checkpoint(docs.withColumn(name, F.monotonically_increasing_id()))
    rows = written.select(F.col(name).alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    kept = _grouped(rows).where("kept").select(F.col("row").alias(f"{name}kept"))
    return written.join(kept, F.col(name) == F.col(f"{name}kept"), "left_semi").select(*docs.columns)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(common.read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP13_SQL = f"""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents
), groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM texts JOIN groups USING (t)
"""
