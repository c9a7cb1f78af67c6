"""Substring deduplication by relative Lempel-Ziv parsing against every earlier text.

The reference that a document is factored against is all text that starts earlier. It is indexed
in content-defined blocks. Every window of ``window`` words picks, of its runs of ``gram`` words, the
one with the smallest hash (its anchor); adjacent windows with the same anchor form a block. Equal
windows pick the same anchor at the same offset, so a block depends only on its words, and a repeated
passage is cut into the same blocks wherever it stands. The index has, for a block, the earliest
place of its words.

What a document has in common with the reference are copies: a block whose words are indexed at an
earlier place, with that place. Where a block isn't repeated as a whole but its anchor is, its windows
are looked up one by one among the blocks with that anchor, so that copies begin and end at the word.
A document is then parsed greedily from left to right (``parse``): copies that continue each other in
one source are one factor; at each word the factor that reaches furthest is taken, and the parse goes
on at its end. At that boundary the windows that cross it have been looked up as well, so every window
that occurs earlier lies within factors that join there, and no other word does. Factors are at least
a window long, or cut off by the factor before.

A word is told by 64 bits, a run of words by 64 bits of its own and 64 of its anchor.

Only blocks with a repeated anchor go past the first count. All aggregations combine before the
shuffle, and joins back to the blocks can be split by adaptive execution, so a passage that a third
of all documents share isn't gathered in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import gram_hashes, run_hashes, word_hashes, words

WINDOW = 20
GRAM = 6


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _hashed(texts: pa.Array):
    """(first row, word hashes, first word of each text) of chunks of the texts."""
    for row, data, offsets in common.text_chunks(texts):
        starts, ends, first = words(data, offsets)
        yield row, word_hashes(data, starts, ends), first


def _blocks(window: int, gram: int, whole: bool):
    """The blocks of whole texts; not ``whole``: only their anchors."""
    choice = window - gram + 1

    def run(batches):
        for batch in batches:
            for row, hashes, first in _hashed(batch.column("text")):
                n = len(hashes) - window + 1
                if n <= 0:
                    continue
                grams = gram_hashes(hashes, gram)
                anchor = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, choice)[:n].argmin(axis=1)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))  # of each word
                inside = text[:n] == text[window - 1 :]
                begins = inside.copy()
                begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
                stops = inside.copy()
                stops[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
                begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                if not len(begin):
                    continue
                out = {"anchor": _signed(grams[anchor[begin]])}
                if whole:
                    of = text[begin]
                    rows = pa.array(of + row)
                    out |= {
                        "block": _signed(run_hashes(hashes, begin, stop + window - 1)),
                        "doc": batch.column("doc").take(rows),
                        "place": pa.array((batch.column("mark").take(rows).to_numpy() << 32) | (begin - first[of])),
                        "n": pa.array((stop - begin).astype(np.int32)),
                    }
                yield pa.RecordBatch.from_pydict(out)

    return run


def _windows(window: int):
    """The windows of the blocks in column ``checks``."""

    def run(batches):
        for batch in batches:
            checks = batch.column("checks")
            for row, hashes, first in _hashed(batch.column("text")):
                part = checks.slice(row, len(first) - 1)
                flat = part.flatten()
                if not len(flat):
                    continue
                of = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                pos, n, anchor = (flat.field(k).to_numpy() for k in range(3))
                each = np.repeat(np.arange(len(pos)), n)
                at = pos[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                begin = at + first[of[each]]
                rows = pa.array(of[each] + row)
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array(anchor[each]),
                        "block": _signed(run_hashes(hashes, begin, begin + window)),
                        "doc": batch.column("doc").take(rows),
                        "place": pa.array((batch.column("mark").take(rows).to_numpy() << 32) | at),
                    }
                )

    return run


def _repeated(found: DataFrame) -> DataFrame:
    """``found`` (anchor, block, doc, place, ...) with ``first``, the earliest (doc, place) of the row's block.

    The earliest places of blocks that come again are written first: a join whose one side comes straight from an
    aggregation can't be split, and a block that is everywhere would be one task's work.
    """
    place = F.struct("doc", "place")
    first = found.groupBy("anchor", "block").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = found.join(common.checkpoint(first), ["anchor", "block"], "left")
    return joined.withColumn("first", F.coalesce("_first", place)).drop("_first")


def _is_first() -> Column:
    return F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.place") == F.col("place"))


def _position(place: str = "place") -> Column:
    return F.col(place).bitwiseAND(0xFFFFFFFF).cast("int")


def _mark(place: str = "place") -> Column:
    return F.shiftrightunsigned(F.col(place), 32)


def _source() -> tuple[Column, Column]:
    """The document that a copy is from, and the number of its first word there."""
    return F.col("first.doc").alias("source"), _position("first.place").alias("at")


def parse(copies: list[tuple], window: int) -> list[tuple]:
    """The greedy parse: factors (start, end, source, its word at ``start``) from copies (pos, n, source, at).

    A copy stands for ``n`` windows. Factors don't overlap; together they cover all that copies cover.
    """
    runs: dict[tuple, list[list]] = {}  # in one source at one distance
    for pos, n, source, at in sorted(copies, key=lambda c: c[0]):
        own = runs.setdefault((source, at - pos), [])
        end = pos + n + window - 1
        if own and pos <= own[-1][1]:
            own[-1][1] = max(end, own[-1][1])
        else:
            own.append([pos, end, source, at])
    out, word, furthest = [], 0, None
    ready = sorted((run for own in runs.values() for run in own), key=lambda run: (run[0], -run[1]))
    k = 0
    while k < len(ready) or furthest:
        while k < len(ready) and ready[k][0] <= word:
            if furthest is None or ready[k][1] > furthest[1]:
                furthest = ready[k]
            k += 1
        if furthest is not None and furthest[1] > word:
            start, end, source, at = furthest
            out.append((word, end, source, at + word - start))
            word = end
        elif k < len(ready):
            word = ready[k][0]
        furthest = furthest if furthest is not None and furthest[1] > word else None
    return out


RESULT = (
    "struct<n_words: bigint, n_removed: bigint, kept: string,"
    " factors: array<struct<start: bigint, end: bigint, source: {kind}, source_start: bigint>>>"
)


def _cut_column(text: Column, spans: Column, window: int, digest: bool, kind: str) -> Column:
    """What the factors of each text leave of it: the text or its SHA-256. ``kind``: the type of a document's id."""

    @F.arrow_udf(RESULT.format(kind=kind))
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        of = spans.type.value_type.field("source").type
        out = []
        for text, found in zip(texts.cast(pa.large_binary()).fill_null(b"").to_pylist(), spans):
            parts = text.split()
            factors = parse([tuple(c.values()) for c in found.as_py()], window) if found.is_valid else []
            left, at = [], 0
            for start, end, *_ in factors:
                left += parts[at:start]
                at = end
            left += parts[at:]
            kept = b" ".join(left)
            out.append(
                {
                    "n_words": len(parts),
                    "n_removed": len(parts) - len(left),
                    "kept": hashlib.sha256(kept).hexdigest() if digest else kept.decode(),
                    "factors": [dict(zip(("start", "end", "source", "source_start"), f)) for f in factors],
                }
            )
        factor = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", of), ("source_start", pa.int64())])
        fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("factors", pa.list_(factor))]
        return pa.array(out, pa.struct(fields))

    return cut(text, spans)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    digest: bool = False,
) -> DataFrame:
    """Each document without the words that a window which starts earlier covers.

    Earlier: in a document with a smaller id, or in the same one at an earlier word. Returns
    (``id_col``, n_words, n_removed, kept, factors), one row per input row: ``kept`` is the words left
    with one space between them (``digest``: its SHA-256 in hex), ``factors`` are the duplicate spans
    as word numbers, each with the document and the word that it is copied from. Null texts have no words; texts with fewer words than a window keep all.
    A null id counts as smaller than any other. Of rows with the same id, equal texts are one
    document and get the same result; different texts are documents in a fixed order of their hashes.
    An empty table gives an empty result. Other columns aren't read.
    """
    common.importable_on_workers(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # Only rows that share an id need a mark to tell their texts apart.
    shared = not docs.groupBy("doc").count().where("count > 1").isEmpty()
    docs = docs.withColumn("mark", F.xxhash64("text").bitwiseAND(0x7FFFFFFF) if shared else F.lit(0).cast("long"))
    kind = docs.schema["doc"].dataType.simpleString()
    shape = f"block bigint, doc {kind}, place bigint"

    anchors = docs.mapInArrow(_blocks(window, gram, whole=False), "anchor bigint")
    # Written, so that the join below reads it by a shuffle and a hot anchor's blocks can be split.
    counted = common.checkpoint(anchors.groupBy("anchor").count().where("count > 1").select("anchor"))
    blocks = docs.mapInArrow(_blocks(window, gram, whole=True), f"anchor bigint, {shape}, n int")
    blocks = common.checkpoint(blocks.join(counted, "anchor", "left_semi"))

    # An anchor with one block only has all its windows in that block's earliest copy.
    several = blocks.groupBy("anchor").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a <> b")
    several = common.checkpoint(several.select("anchor", F.lit(True).alias("several")))  # as above, for a hot anchor
    placed = _repeated(blocks).join(several, "anchor", "left").where(~_is_first() | F.col("several"))
    # A block is a copy, or (with its anchor) the boundary of one.
    judged = placed.select(
        "doc",
        _mark().alias("mark"),
        _position().alias("pos"),
        "n",
        F.when(_is_first(), F.col("anchor")).alias("anchor"),
        *_source(),
    )
    judged = common.checkpoint(judged)
    copied = judged.where("anchor IS NULL").drop("anchor")
    at_boundary = judged.where("anchor IS NOT NULL").groupBy("doc", "mark")
    checks = at_boundary.agg(F.collect_set(F.struct("pos", "n", "anchor")).alias("checks"))

    def with_docs(found: DataFrame, how: str) -> DataFrame:
        found = found.withColumnsRenamed({"doc": "d", "mark": "m"})
        same = docs["doc"].eqNullSafe(found["d"]) & (docs["mark"] == found["m"])
        return docs.join(found, same, how).drop("d", "m")

    looked_up = with_docs(checks, "inner").dropDuplicates(["doc", "mark"]).select("doc", "text", "mark", "checks")
    single = _repeated(looked_up.mapInArrow(_windows(window), f"anchor bigint, {shape}"))
    single = single.where(~_is_first()).select("doc", _mark().alias("mark"), _position().alias("pos"), F.lit(1).alias("n"), *_source())
    single = common.checkpoint(single)
    spans = copied.unionByName(single).groupBy("doc", "mark").agg(F.collect_set(F.struct("pos", "n", "source", "at")).alias("spans"))
    cut = with_docs(spans, "left").select("doc", _cut_column(F.col("text"), F.col("spans"), window, digest, kind).alias("c"))
    return cut.select(F.col("doc").alias(id_col), "c.n_words", "c.n_removed", "c.kept", "c.factors")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.read(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM grams) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM repeated
), kept AS (
  SELECT d.doc_id, d.p, d.word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) d
  LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL
), texts AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN texts USING (doc_id)
"""
