"""Benchmark decontamination with an Aho-Corasick automaton over the normalised benchmark texts.

Normalised text is the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in
lower case, with one space before, between and after them. The automaton holds every window of
``window`` consecutive words of an item (an item with fewer words, but some, is one window), so one
scan of a document finds every occurrence of every window. Hits are mapped back to the words and
to the code points of the original text.

The benchmark reaches the workers in blocks of at most ``block_bytes`` of text, so what is
broadcast and the size of an automaton are bounded; a benchmark of several blocks is scanned
against the same batch of documents block by block. Documents are neither shuffled nor gathered.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Benchmark text in one automaton. Each byte becomes about ``window`` nodes of some 60 bytes.
BLOCK_BYTES = 256 << 10
#: Automata that a worker keeps.
KEPT = 2

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
#: Byte by byte: A-Z to lower case, what is in no word to a space.
_NORMAL = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))

RESULT = (
    "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items: string,"
    " spans: array<struct<start: bigint, end: bigint>>>"
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def automaton_of(items: list[tuple[str | None, bytes]], window: int):
    """(automaton or None, item ids by number). Values: (characters of the key, words of it, item numbers)."""
    found: dict[bytes, tuple[int, set[int]]] = {}
    ids: list[str | None] = []
    for number, (item, text) in enumerate(items):
        ids.append(item)
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            key = b" " + b" ".join(part) + b" "
            found.setdefault(key, (len(part), set()))[1].add(number)
    if not found:
        return None, ids
    automaton = ahocorasick.Automaton()
    for key, (n, numbers) in found.items():
        automaton.add_word(key.decode("latin-1"), (len(key), n, tuple(numbers)))
    automaton.make_automaton()
    return automaton, ids


_automata: OrderedDict[tuple, tuple] = OrderedDict()


def _automaton(block, window: int):
    digest, items = block.value
    key = (digest, window)
    if key in _automata:
        _automata.move_to_end(key)
    else:
        while len(_automata) >= KEPT:
            _automata.popitem(last=False)
        _automata[key] = automaton_of(items, window)
    return _automata[key]


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Code-point spans of the runs of hit words; a word's bytes lie where they lie in ``text``."""
    normal = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edges = np.diff(normal.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    runs = np.diff(hit.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b]])} for a, b in zip(first, last)]


def scan(texts: list[bytes], blocks, window: int) -> list[dict]:
    """One result a text; ``blocks`` are read one after another for the whole batch."""
    joined = [b" ".join([b"", *words, b""]) if (words := words_of(t)) else b"" for t in texts]
    counts = [max(0, j.count(b" ") - 1) for j in joined]
    hits: dict[int, np.ndarray] = {}
    items: dict[int, set[str]] = {}
    for block in blocks:
        automaton, ids = _automaton(block, window)
        if automaton is None:
            continue
        for i, line in enumerate(joined):
            spaces = None
            for end, (length, n, numbers) in automaton.iter(line.decode("latin-1")):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                    delta = np.zeros(counts[i] + 1, np.int64)
                first = int(np.searchsorted(spaces, end - length + 1))
                delta[first] += 1
                delta[first + n] -= 1
                items.setdefault(i, set()).update(x for k in numbers if (x := ids[k]) is not None)
            if spaces is not None:
                hit = np.cumsum(delta[:-1]) > 0
                hits[i] = hits[i] | hit if i in hits else hit
    out = []
    for i, text in enumerate(texts):
        found = sorted(items.get(i, ()))
        out.append(
            {
                "n_words": counts[i],
                "n_hit": int(hits[i].sum()) if i in hits else 0,
                "n_items": len(found),
                "items": ",".join(found),
                "spans": _spans(text, hits[i]) if i in hits else [],
            }
        )
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list:
    """Broadcasts of (digest, items) of at most ``block_bytes`` of text, or of one longer item."""
    sc = benchmark.sparkSession.sparkContext
    blocks, items, size = [], [], 0

    def close() -> None:
        digest = hashlib.sha256(repr(items).encode()).hexdigest()
        blocks.append(sc.broadcast((digest, list(items))))
        items.clear()

    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    for item, text in rows.where(F.col(text_col).isNotNull()).toLocalIterator():
        if items and size + len(text) > block_bytes:
            close()
            size = 0
        items.append((item, bytes(text)))
        size += len(text)
    if items:
        close()
    return blocks


def contamination(
    text: Column,
    benchmark: DataFrame,
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> Column:
    """A column of what the automaton finds in ``text``: a struct of ``n_words``, ``n_hit``, ``n_items``,
    ``items`` (ids as strings, sorted, comma-joined) and ``spans`` of the original's code points.

    A null text has no words. Null benchmark texts and items without words have no windows; an
    item with a null id counts for hits but isn't listed. Repeated items count once by their id.
    """
    spark = benchmark.sparkSession
    common.importable_on_workers(spark)
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)

    @F.arrow_udf(RESULT)
    def find(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("n_hit", pa.int64()),
                ("n_items", pa.int64()),
                ("items", pa.string()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
        )
        return pa.array(scan(texts.to_pylist(), blocks, window), kind)

    return find(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window; columns and other rows unchanged.

    An empty table stays empty; rows with a null text stay, having no words. Repeated rows are
    judged alike. Extra columns of any name pass through.
    """
    found = common.spare_name(docs, "contamination")
    marked = docs.withColumn(found, contamination(F.col(text_col), benchmark, **options))
    return marked.where(F.col(found)["n_hit"] == 0).drop(found)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (common.read(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = docs.select("doc_id", contamination(F.col("text"), benchmark).alias("f"))
    return found.select(
        "doc_id",
        "f.n_words",
        "f.n_hit",
        "f.n_items",
        F.sha2("f.items", 256).alias("items_sha256"),
        (F.col("f.n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH norm AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM norm, sizes WHERE len(w) >= n)
), found AS (
  SELECT DISTINCT r, g.n, i, item_id FROM grams g JOIN windows v ON g.n = v.n AND g.key = v.key
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""
