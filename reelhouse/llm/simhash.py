"""SimHash near-duplicates with pivot distance tables.

Fingerprints within ``radius`` bits agree in at least ``BLOCKS - radius`` of ``BLOCKS`` blocks of
bits, so every such pair shares a key made of two blocks. Within a key, each fingerprint has a row
of Hamming distances to fixed reference fingerprints (the pivots). By the triangle inequality a
pair's distance is at least the largest difference between its rows; pairs for which that is over
the radius are discarded, and the survivors are verified bit by bit. What leaves a key is a
spanning forest of its links, at most a row for each fingerprint, which joins the same components
as all links do.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RADIUS = 4
SHINGLE = 4
#: Blocks of a fingerprint's 64 bits: (first bit, bits). For radius 4, two of six agree.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Reference fingerprints: 16 fixed pseudo-random ones.
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 16, np.uint64)
#: From this size a key's rows are searched breadth first instead of pair by pair.
LARGE = 16
#: A key with more fingerprints is split by blocks of its other bits.
HOT_KEY = 20_000

_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is set where over half of the shingles' XXH64 have it set; no words: 0."""
    words = text.lower().split()  # of bytes: A-Z only, and [ \\t-\\r] separate
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    starts, digest = starts[:n].tolist(), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _SHINGLES_AT_ONCE):
        part = [digest(joined[a:b], 42) for a, b in zip(starts[k : k + _SHINGLES_AT_ONCE], last[k : k + _SHINGLES_AT_ONCE])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(spark: SparkSession, text: Column, shingle: int = SHINGLE) -> Column:
    """Each whole text's fingerprint as a signed long; null text: 0."""
    common.importable_on_workers(spark)

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary()).fill_null(b"").to_pylist()
        return pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _distances(x: np.ndarray) -> np.ndarray:
    """The pivot table: a row of distances for each fingerprint."""
    return np.bitwise_count(x[:, None] ^ PIVOTS[None, :]).astype(np.int16)


def _search(x: np.ndarray, radius: int) -> tuple[list, list]:
    """A spanning forest of the links in one large key, by breadth-first search over what isn't reached yet."""
    table = _distances(x)
    order = np.argsort(table[:, 0], kind="stable")
    x, table = x[order], table[order]
    first = table[:, 0]
    left, heads, tails = np.ones(len(x), bool), [], []
    for root in range(len(x)):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            a, b = np.searchsorted(first, [first[i] - radius, first[i] + radius + 1])
            at = a + np.flatnonzero(left[a:b])
            at = at[np.abs(table[at] - table[i]).max(axis=1, initial=0) <= radius]
            at = at[np.bitwise_count(x[at] ^ x[i]) <= radius]
            left[at] = False
            stack.extend(at.tolist())
            heads.append(np.full(len(at), x[i]))
            tails.append(x[at])
    return heads, tails


def _links(keys: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints ``x`` of whole, adjacent groups with equal ``keys``."""
    heads, tails = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
    large = ends - starts >= LARGE
    for a, b in zip(starts[large].tolist(), ends[large].tolist()):
        found = _search(np.unique(x[a:b]), radius)
        heads += found[0]
        tails += found[1]
    small = np.repeat(~large & (ends - starts > 1), ends - starts)
    keys, x = keys[small], x[small]
    table = _distances(x)
    for step in range(1, LARGE):
        i = np.flatnonzero(keys[:-step] == keys[step:]) if step < len(keys) else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[np.abs(table[i] - table[i + step]).max(axis=1) <= radius]
        i = i[np.bitwise_count(x[i] ^ x[i + step]) <= radius]
        heads.append(x[i])
        tails.append(x[i + step])
    return np.concatenate(heads), np.concatenate(tails)


def _within_keys(radius: int):
    def run(batches):
        keys, x = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(a, b):
            found = _links(keys[a:b], x[a:b], radius)
            return pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)) for e in found], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            x = np.concatenate([x, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys):
                cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if cut:
                    yield out(0, cut)
                    keys, x = keys[cut:], x[cut:]
        if len(keys):
            yield out(0, len(keys))

    return run


def _bits(fp: Column, first: int, n: int) -> Column:
    return fp if n == 64 else F.shiftrightunsigned(fp, first).bitwiseAND((1 << n) - 1)


def _two_blocks(fp: Column) -> Column:
    """An array of keys, one for each two of the blocks."""
    keys = []
    for number, (p, q) in enumerate(combinations(BLOCKS, 2)):
        low, high = _bits(fp, *p), F.shiftleft(_bits(fp, *q), p[1])
        keys.append(low.bitwiseOR(high).bitwiseOR(F.lit(number << 22)).cast("long"))
    return F.array(*keys)


def _finer(key: Column, fp: Column, radius: int) -> Column:
    """Keys for the rows of a hot key: the old key and one of radius + 1 parts of the whole fingerprint.

    Two fingerprints within the radius agree in at least one of the parts.
    """
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    parts = [F.xxhash64(key, F.lit(i), _bits(fp, cuts[i], cuts[i + 1] - cuts[i])) for i in range(n)]
    return F.array(*parts)


def links(fingerprints: DataFrame, radius: int = RADIUS, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column ``fp`` that join all within ``radius`` bits."""
    if not 0 <= radius <= 4:
        raise ValueError("two of six blocks agree for a radius of up to 4")
    common.importable_on_workers(fingerprints.sparkSession)
    fps = fingerprints.select("fp").where("fp IS NOT NULL").distinct()
    keyed = fps.select(F.explode(_two_blocks(F.col("fp"))).alias("key"), "fp")
    hot = keyed.groupBy("key").count().where(F.col("count") > hot_key).select(F.col("key").alias("hot"))
    marked = keyed.join(hot, keyed["key"] == hot["hot"], "left")
    keys = F.when(F.col("hot").isNull(), F.array("key")).otherwise(_finer(F.col("key"), F.col("fp"), radius))
    keyed = marked.select(F.explode(keys).alias("key"), "fp")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_within_keys(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(``id_col``, fp, component_id), one row per input row: the smallest id reachable by links.

    Every distinct fingerprint is looked at once, however many documents have it, so copies add no
    pairs. A null or empty text has fingerprint 0, which links like any other. Rows with a null id
    get the component of their fingerprint (null if no row of it has an id); repeated rows are
    returned as often as they come. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    prints = common.checkpoint(docs.select(F.col(id_col), fingerprint_column(spark, F.col(text_col), shingle).alias("fp")))
    first = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    joined = common.connected_components(links(prints, radius), "a", "b")
    rooted = first.join(joined, first["fp"] == joined["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select(id_col, "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
