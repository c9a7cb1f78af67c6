"""Phrases whose words go together, counted by an FM-index in each shard of the text.

A shard is some of one language's texts, about ``SHARD`` words. Its words are numbered, and two depth-limited
Burrows-Wheeler transforms of the numbers are kept, of the text and of the text reversed: suffixes are in order of
their first four words, which is all that phrases of up to four words need. Occurrences of a phrase are an interval of
either order. One step adds a word on the left by the forward transform, or on the right by the reversed one, to
all intervals at once (``Index.extended``), and gives each longer phrase its count and both of its intervals.

Phrases are enumerated by length. A phrase counts only if it occurs ``LEAST`` times in all shards of its
language, and then so do its parts. So each shard lists the phrases of k + 1 words whose first k and last k words both
reached that number, the shards' counts are summed, and those that reach it go back to the shards they came
from, with their intervals, to be extended. Phrases are told apart by the numbers of their two parts, which
are exact, not by hashes; a phrase's number is the place of its interval in one of its shards.

A shard sends a row for each of its different phrases, so a phrase that is everywhere has as many rows as there are
shards. No list of phrases is sent to all tasks, and none passes through the driver. A text is read whole; only a piece
without any punctuation can make a shard larger than ``SHARD``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words of a shard, about.
SHARD = 1 << 21
#: Occurrences of a phrase; per cent of them that a longer phrase must have to stand for it; phrases of a language.
LEAST, COVERED, FIRST = 30, 80, 2000
#: Turns in which longer phrases are listed.
TURNS = 2
#: Parts into which a language's phrases are dealt to find its first ones.
PARTS = 256

_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _SPACE
_KIND[list(b".,;:!?\n\v\f\r")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words end to end, their lengths, whether each begins a piece) of some texts."""
    kind = _KIND[data]
    inside = kind == _WORD
    cut = np.zeros(len(data) + 1, bool)  # a text begins here
    cut[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    piece = (np.cumsum(kind == _BREAK) + np.cumsum(cut[:-1]))[starts]
    return _LOWER[data[inside]], (ends - starts).astype(np.int32), np.diff(piece, prepend=-1) != 0


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.int32), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd"), np.int32)


def transforms(tokens: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The words before (forward order) and after (reversed order) each place of ``tokens``, read as a circle.

    ``tokens``: numbers from 1 to ``n_words``, and 0 for a border between pieces, at both ends too.
    """
    out = []
    for step in (1, -1):
        rank = tokens.astype(np.int64)
        size = n_words + 1
        for depth in (1, 2):
            key = rank * size + np.roll(rank, -step * depth)
            order = np.argsort(key)
            if depth == 1:
                rank = np.empty(len(key), np.int64)
                rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
                size = len(key) + 1
        out.append(np.roll(tokens, step)[order])
    return out[0], out[1]


class Index:
    """Both transforms of a shard. Intervals are (first place, first place in the other order, length)."""

    def __init__(self, before: np.ndarray, after: np.ndarray) -> None:
        counts = np.bincount(before)
        self.firsts = np.concatenate([[0], np.cumsum(counts)])
        self.symbols = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.sides = (before, after)

    def steps(self, side: int) -> np.ndarray:
        """Where the suffix that is longer by the word of each place stands: by word, then by place."""
        order = np.sort(self.sides[side].astype(np.uint64) << np.uint64(32) | np.arange(len(self.symbols), dtype=np.uint64))
        out = np.empty(len(order), np.int64)
        out[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.arange(len(order))
        return out

    def extended(self, side: int, lo: np.ndarray, other: np.ndarray, n: np.ndarray):
        """Every phrase that a word makes of one of the intervals: (its interval before, its three numbers).

        side 0: the word is put before the phrase, and ``lo`` is of the forward order. side 1: after it, and
        ``lo`` is of the reversed order. In the other order the longer phrase lies within the shorter one's interval, by
        the words added; borders come first there and make no phrase.
        """
        ends = np.cumsum(n)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        group = np.repeat(np.arange(len(n)), n)
        places = self.steps(side)[np.repeat(lo, n) + within]
        key = np.sort(group.astype(np.uint64) << np.uint64(32) | places.astype(np.uint64))
        group = (key >> np.uint64(32)).astype(np.int64)
        places = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        word = self.symbols[places]
        new = np.ones(len(key), bool)
        new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        real = word[at] > 0
        at, size = at[real], size[real]
        of = group[at]
        return of, places[at], other[of] + at - (ends - n)[of], size


def _shard(task: int, number: int, lang: str, held: list) -> pa.RecordBatch:
    data = np.concatenate([h[0] for h in held])
    lengths = np.concatenate([h[1] for h in held])
    begins = np.concatenate([h[2] for h in held])
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    tokens = np.zeros(len(codes) + int(begins.sum()) + 1, np.int32)
    tokens[np.arange(len(codes)) + np.cumsum(begins)] = codes + 1
    before, after = transforms(tokens, len(coded.dictionary))
    counts = np.bincount(codes)
    # A word's interval is the same in both orders: after the borders and all words of smaller numbers.
    starts = len(tokens) - len(codes) + np.cumsum(counts) - counts
    return pa.RecordBatch.from_arrays(
        [
            pa.array([task << 12 | number], pa.int64()),
            pa.array([lang], pa.string()),
            pa.array([len(tokens)], pa.int64()),
            pa.array([_packed(before)], pa.binary()),
            pa.array([_packed(after)], pa.binary()),
            pa.array([coded.dictionary.cast(pa.large_string()).to_pylist()], pa.list_(pa.string())),
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([starts], pa.list_(pa.int64())),
        ],
        names=["shard", "lang", "n", "before", "after", "words", "counts", "starts"],
    )


SHARDS = "shard bigint, lang string, n bigint, before binary, after binary, words array<string>, counts array<bigint>, starts array<bigint>"


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SHARD) -> DataFrame:
    """The indexes of all texts, as rows of ``SHARDS``; a null language is ``und``, a null text empty."""
    common.importable_on_workers(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = batch.filter(pa.compute.equal(batch.column("lang"), lang))
                for _, data, offsets in common.text_chunks(own.column("text")):
                    found = _words(data, offsets)
                    if not len(found[1]):
                        continue
                    held.setdefault(lang, []).append(found)
                    sizes[lang] = sizes.get(lang, 0) + len(found[1])
                    while sum(sizes.values()) >= size:
                        largest = max(sizes, key=sizes.get)
                        sizes.pop(largest)
                        yield _shard(task, number, largest, held.pop(largest))
                        number += 1
        for lang in held:
            yield _shard(task, number, lang, held[lang])
            number += 1
            if number > 1 << 12:
                raise ValueError("too many shards in a task: take a larger size, or smaller partitions")

    return rows.mapInArrow(run, SHARDS)


#: A phrase in a shard: ``own``, the shard and the first place of its interval; the numbers of the phrase without its last,
#: and without its first word; ``no``, its count and its first place in the other order. A row of four longs, as there may be as many as words.
GRAMS = "own bigint, l bigint, r bigint, no bigint"
_LOW = 31


def _packed_pair(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), _LOW).bitwiseOR(low.cast("long"))


def _frequent(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """The rows whose counts sum up to ``least`` within their key, with the sum ``f`` and a number ``id`` of the key."""
    same = Window.partitionBy(*key)
    summed = rows.select("*", F.sum(F.shiftright("no", _LOW)).over(same).alias("f"), F.min("own").over(same).alias("id"))
    return common.checkpoint(summed.where(F.col("f") >= least))


def _longer(index: DataFrame, known: DataFrame, side: int, turn: int, turns: int) -> DataFrame:
    """Rows of ``GRAMS``: each shard's phrases that are longer by a word and of which both parts are ``known``.

    Phrases are extended whose number falls to this ``turn``.
    """

    def run(shard: pa.Table, grams: pa.Table) -> pa.Table:
        kinds = pa.schema([(c.split()[0], pa.int64()) for c in GRAMS.split(", ")])
        if not shard.num_rows or not grams.num_rows:
            return kinds.empty_table()
        n = shard["n"][0].as_py()
        index = Index(*(_unpacked(shard[c][0].as_py(), n) for c in ("before", "after")))
        own, no, ids = (grams[c].to_numpy() for c in ("own", "no", "id"))
        low = (1 << _LOW) - 1
        lo, other, size = (no & low, own & low, no >> _LOW) if side else (own & low, no & low, no >> _LOW)
        order = np.argsort(lo)
        lo, other, size, ids = lo[order], other[order], size[order], ids[order]
        mine = np.flatnonzero(ids % turns == turn)
        of, new_lo, new_other, new_size = index.extended(side, lo[mine], other[mine], size[mine])
        # In the order of ``side``, the new phrase lies within the interval of its part with the new word.
        at = np.searchsorted(lo, new_lo, side="right") - 1
        within = (at >= 0) & (new_lo < lo[at] + size[at])
        of, at, new_lo, new_other, new_size = (x[within] for x in (mine[of], at, new_lo, new_other, new_size))
        left, right = (ids[of], ids[at]) if side else (ids[at], ids[of])
        first, second = (new_other, new_lo) if side else (new_lo, new_other)
        columns = (shard["shard"][0].as_py() << _LOW | first, left, right, new_size << _LOW | second)
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=kinds)

    grams = known.select(F.shiftright("own", _LOW).alias("of"), "own", "no", "id").groupBy("of")
    return index.select("shard", "n", "before", "after").groupBy("shard").cogroup(grams).applyInArrow(run, GRAMS)


def _extended(index: DataFrame, known: DataFrame, side: int, least: int, turns: int) -> DataFrame:
    """The frequent phrases that are longer by a word than those ``known``, with a row for each shard.

    Most phrases are rare, and all of them are listed to find that out. They are listed in ``turns``, one
    after the other, so that the shuffle files of one turn are there at a time.
    """
    found = [_frequent(_longer(index, known, side, turn, turns), ["l", "r"], least) for turn in range(turns)]
    return functools.reduce(DataFrame.unionByName, found)


def _own(rows: DataFrame) -> DataFrame:
    """One row for each number."""
    return rows.where("own = id")


def _part(grams: DataFrame, side: str, *columns: str) -> DataFrame:
    return grams.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, size: int = SHARD, turns: int = TURNS
) -> tuple[DataFrame, ...]:
    """Words, and phrases of 2, 3 and 4 words, that occur ``least`` times: (id, lang, phrase, last, f, n, cuts, l, r).

    ``last``: the last word. ``n``: the language's words. ``cuts``: for each place to cut the phrase, the counts (l, r) of
    its two parts. ``l`` and ``r``: numbers of the phrase without its last, and without its first word.
    """
    index = common.checkpoint(shards(docs, text_col, lang_col, size))
    listed = index.select("shard", "lang", F.explode(F.arrays_zip("words", "counts", "starts")).alias("w"))
    total = listed.groupBy("lang").agg(F.sum("w.counts").alias("total"))
    start = F.col("w.starts")
    words = listed.select("lang", F.col("w.words").alias("word"), _packed_pair(F.col("shard"), start).alias("own"), _packed_pair(F.col("w.counts"), start).alias("no"))
    words = _frequent(words, ["lang", "word"], least)
    pairs = _extended(index, words, 1, least, turns)
    triples = _extended(index, pairs, 0, least, turns)
    fours = _extended(index, triples, 1, least, turns)

    def counts(rows: DataFrame, parts: DataFrame) -> DataFrame:
        kept = ("phrase", "f", "cuts", "lang", "n", "last")
        both = _own(rows).select("id", "l", "r", "f").join(_part(parts, "l", *kept), "l").join(_part(parts, "r", *kept), "r")
        first = F.when(F.size("l_cuts") == 0, F.col("l_f")).otherwise(F.try_element_at("l_cuts", F.lit(1))["l"])
        final = F.when(F.size("r_cuts") == 0, F.col("r_f")).otherwise(F.try_element_at("r_cuts", F.lit(-1))["r"])
        # Cut after the first word; the cuts in between are those that both parts have inside; cut before the last word.
        inner = F.zip_with(F.slice("l_cuts", 2, 9), F.slice("r_cuts", 1, F.greatest(F.size("r_cuts") - 1, F.lit(0))), lambda a, b: F.struct(a["l"].alias("l"), b["r"].alias("r")))
        ends = [F.array(F.struct(first.alias("l"), F.col("r_f").alias("r")))]
        if rows is not pairs:
            ends += [inner, F.array(F.struct(F.col("l_f").alias("l"), final.alias("r")))]
        phrase = F.concat("l_phrase", F.lit(" "), "r_last")
        return common.checkpoint(
            both.select("id", F.col("l_lang").alias("lang"), phrase.alias("phrase"), F.col("r_last").alias("last"), "f", F.col("l_n").alias("n"), F.concat(*ends).alias("cuts"), "l", "r")
        )

    none = F.array().cast("array<struct<l:bigint,r:bigint>>")
    ones = _own(words).join(total, "lang").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.col("total").alias("n"), none.alias("cuts"))
    ones = common.checkpoint(ones)
    twos = counts(pairs, ones)
    threes = counts(triples, twos)
    return ones, twos, threes, counts(fours, threes)


def score(a: Column, left: Column, right: Column) -> Column:
    """2,000,000 a / (l + r), rounded down, in decimals of 38 digits."""
    wide = a.cast("decimal(38,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    return F.call_function("div", wide, (left + right).cast("decimal(19,0)")).cast("long")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, covered: int = COVERED, first: int = FIRST, size: int = SHARD
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of 2 to 4 words.

    A phrase's score is that of its lowest-scoring cut, of several the first one. Left out are phrases of which a longer one that
    occurs ``least`` times makes up ``covered`` per cent; as counts only fall with length, it is enough to look at phrases
    longer by a word. Null texts are empty, a null language is ``und``; repeated rows count each. No texts give no rows.
    """
    _, *grams = phrase_counts(docs, text_col, lang_col, least, size)
    left = []
    for own, longer in zip(grams, [*grams[1:], None]):
        if longer is not None:
            sides = longer.select(F.explode(F.array("l", "r")).alias("id"), F.col("f").alias("longer"))
            most = common.checkpoint(sides.groupBy("id").agg(F.max("longer").alias("longer")))
            own = own.join(most, "id", "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True)))
        left.append(own.select("lang", "phrase", "f", "n", "cuts"))
    rows = left[0].unionByName(left[1]).unionByName(left[2])
    scored = F.array_min(F.transform("cuts", lambda c, k: F.struct(score(F.col("f"), c["l"], c["r"]).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    rows = rows.select("lang", "phrase", F.col("f").alias("a"), "n", scored.alias("c"))
    rows = rows.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    order = (F.col("score").desc(), F.col("a").desc(), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM worded, range(1, 5) ks(k) WHERE len(ws) >= k
), counted AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
parts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM counted),
cut AS (
  SELECT lang, phrase, a, c.k AS cut, array_to_string(ws[:c.k], ' ') AS head, array_to_string(ws[c.k + 1:], ' ') AS tail
  FROM parts p, range(1, 4) c(k) WHERE c.k < p.k
), cuts AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, cut, CAST(c.a AS HUGEINT) * 2000000 // (x.a + y.a) AS score
  FROM cut c JOIN counted x ON x.lang = c.lang AND x.phrase = head JOIN counted y ON y.lang = c.lang AND y.phrase = tail
), lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts),
inner_ AS (
  SELECT p.lang, array_to_string(p.ws[s.i:s.i + m.k - 1], ' ') AS phrase, max(p.a) AS longer FROM parts p, range(2, 4) m(k), range(1, 4) s(i)
  WHERE m.k < p.k AND s.i <= p.k - m.k + 1 GROUP BY ALL
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
  FROM lowest JOIN totals USING (lang) LEFT JOIN inner_ USING (lang, phrase) WHERE nth = 1 AND (longer IS NULL OR 100 * longer < {COVERED} * a)
)
SELECT * FROM ranked WHERE rank <= {FIRST}
"""
