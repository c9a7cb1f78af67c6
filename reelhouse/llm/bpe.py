"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes are a linked list of parts. Every adjacent pair whose joined bytes have a
merge rank sits in the bucket of that rank; a two-level bitmap over the ranks marks the buckets
that are not empty, so find-first-set on one word of each level gives the next rank to merge. A merge
does not search the queue for the pairs it destroys: their entries stay and are skipped as stale
when they come up. The work is O(n log n) in a pre-token's length (the logarithm from keeping
the positions of one bucket in order), so a pre-token of a hundred thousand bytes costs no more
for each byte than a short one. The short pre-tokens of many texts share one queue, so that a bucket's
merges are array operations over many of them; each different one is encoded once for those texts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pre-tokens, words and other pieces whose ids a worker remembers: so many met lately, and as many before them,
#: none longer than ``LONGEST`` characters, so that their bytes are bounded as well. Only speed depends on it.
REMEMBERED = {"tokens": 150_000, "words": 150_000, "spans": 20_000}
LONGEST = 48
#: Characters of text whose new pre-tokens are encoded together.
AT_ONCE = 4 << 20
#: Of a word of letters, these and a line feed between or after them are pre-tokens of their own.
_SIGNS = ".,;:!?"
_TWO_LINES = rf"\A(?P<a>\pL+[{_SIGNS}]*)\n(?P<b>\pL+[{_SIGNS}]*)\z"


def load_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks from a file of lines ``base64(bytes) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


#: Packs so many ids.
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(33)]
#: 1 << k for the 256 ranks of a word of the bitmap's lower level.
_BIT = [1 << k for k in range(256)]


#: Bits for the right one of two ids that are looked up together.
_SHIFT = 32


class Merges:
    """A vocabulary's ranks, as the queue needs them; an id is a token's rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        get = ranks.get
        self.single = [get(bytes([b]), -1) for b in range(256)]
        #: Rank of two adjacent parts joined, by their ids.
        self.joined: dict[int, int] = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = get(piece[:cut]), get(piece[cut:])
                if left is not None and right is not None:
                    self.joined[left << _SHIFT | right] = rank
        size = max(ranks.values(), default=0) + 1
        self.no_id = size  # of what lies beyond a pre-token
        pairs = sorted(((key >> _SHIFT) * (size + 1) + (key & (1 << _SHIFT) - 1), rank) for key, rank in self.joined.items())
        self.pair_keys, self.pair_ranks = np.array([*pairs, (1 << 62, -1)], np.int64).T.copy()
        single = np.array(self.single, np.int64)
        #: Rank of two adjacent bytes joined.
        self.bytes_joined = np.where((single[:, None] < 0) | (single < 0), -1, self.ranks_of(single[:, None], single))
        self.leaves = [0] * ((size >> 8) + 1)  # all zero between pre-tokens
        self.heads = [-1] * size  # all -1 between pre-tokens


    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two ids joined, -1 where they don't join."""
        return self.found(left * (self.no_id + 1) + right)

    def found(self, keys: np.ndarray) -> np.ndarray:
        at = self.pair_keys.searchsorted(keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)


def encode_pieces(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """Packed ids of many short pre-tokens."""
    packed, cuts = encode_bytes(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64), merges)
    cuts = cuts.tolist()
    return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


def encode_bytes(data: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[bytes, np.ndarray]:
    """Packed ids of many short pre-tokens by one queue, which holds the positions of all of them, and the offsets of each one's.

    A bucket is taken whole, and of each pre-token its first position that isn't stale is merged, for all
    pre-tokens at once; the others go back, as the merge may have made a pair of a lower rank. So each
    pre-token's merges come in the order in which ``encode_piece`` makes them.
    """
    n, beyond = len(data), merges.no_id
    ids = np.append(np.array(merges.single, np.int64)[data], beyond)
    if (ids < 0).any():
        raise KeyError("a byte that isn't in the vocabulary")
    owner = np.repeat(np.arange(len(lengths)), lengths)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.cumsum(lengths)
    after[ends - 1] = before[ends - lengths] = after[n] = n
    pair_rank = np.full(n + 1, -1)
    inner = np.flatnonzero(after[:n] < n)
    pair_rank[inner] = merges.bytes_joined[data[inner], data[inner + 1]]
    alive = np.ones(n, bool)
    leaves, bit = merges.leaves, _BIT
    top = 0
    buckets: dict[int, list[np.ndarray]] = {}
    ranks, at = pair_rank[:n], np.arange(n)
    while True:
        if len(at := at[(new := ranks >= 0)]):
            ranks = ranks[new]
            order = ranks.argsort(kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = [0, *((ranks[1:] != ranks[:-1]).nonzero()[0] + 1).tolist(), len(ranks)]
            for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if rank in buckets:
                    buckets[rank].append(at[a:b])
                else:
                    buckets[rank] = [at[a:b]]
                    word = rank >> 8
                    leaves[word] |= bit[rank & 255]
                    top |= bit[word]
        if not top:
            break
        word = (top & -top).bit_length() - 1
        bits = leaves[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        bucket = buckets.pop(rank)
        at = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
        leaves[word] = bits = bits & bits - 1
        if not bits:
            top ^= bit[word]
        ranks = at = at[pair_rank[at] == rank]  # the others are stale
        if not len(at):
            continue
        if len(at) > 1:
            at = np.sort(at)
            of = owner[at]
            again = np.zeros(len(at), bool)
            np.equal(of[1:], of[:-1], out=again[1:])
            if again.any():
                buckets[rank] = [at[again]]
                leaves[word] |= bit[rank & 255]
                top |= bit[word]
                at = at[~again]
        middle = after[at]
        end = after[middle]
        alive[middle] = False
        pair_rank[middle] = -1
        ids[at], after[at], before[end] = rank, end, at
        left = before[at]
        ranks = merges.found(np.concatenate([rank * (beyond + 1) + ids[end], ids[left] * (beyond + 1) + rank]))
        at = np.concatenate([at, left])
        pair_rank[at] = ranks
        pair_rank[n] = -1
    packed = ids[:n][alive].astype("<u4").tobytes()
    return packed, np.concatenate([[0], np.cumsum(np.bincount(owner[alive], minlength=len(lengths))) * 4])


def encode_piece(piece: bytes, merges: Merges) -> list[int]:
    """Ids of one pre-token. Raises KeyError when the vocabulary lacks a byte of it.

    A bucket is its only position, or -2 where several are in a heap of ``several``. The queue is
    written out in place, as calls would take most of the time of a short pre-token.
    """
    whole = merges.ranks.get(piece)
    if whole is not None:
        return [whole]
    leaves, heads, bit, get = merges.leaves, merges.heads, _BIT, merges.joined.get
    single = merges.single
    ids = [single[b] for b in piece]  # of the part that begins at a position
    if -1 in ids:
        raise KeyError(piece)
    n = len(piece)
    top = 0  # the upper level: which words of ``leaves`` aren't zero
    several: dict[int, list[int]] = {}
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    pair_rank = [get(a << _SHIFT | b, -1) for a, b in zip(ids, ids[1:])]  # of the pair that begins at a position
    i = 0
    for rank in pair_rank:
        if rank >= 0:
            head = heads[rank]
            if head == -1:
                heads[rank] = i
                word = rank >> 8
                leaves[word] |= bit[rank & 255]
                top |= bit[word]
            elif head == -2:
                several[rank].append(i)  # positions come in order: a heap
            else:
                heads[rank] = -2
                several[rank] = [head, i]
        i += 1
    pair_rank.append(-1)
    while top:
        word = (top & -top).bit_length() - 1
        bits = leaves[word]
        lowest = bits & -bits
        rank = word << 8 | lowest.bit_length() - 1
        i = heads[rank]
        if i == -2:
            bucket = several[rank]
            i = heappop(bucket)
            if len(bucket) == 1:
                heads[rank] = bucket[0]
                del several[rank]
        else:
            heads[rank] = -1
            leaves[word] = bits = bits ^ lowest
            if not bits:
                top ^= bit[word]
        if pair_rank[i] != rank:
            continue  # stale: the pair was merged away or has grown since
        middle = after[i]
        end = after[i] = after[middle]
        ids[i] = rank
        pair_rank[middle] = pair_rank[i] = -1
        grown = []
        if end < n:
            before[end] = i
            new = get(rank << _SHIFT | ids[end], -1)
            if new >= 0:
                pair_rank[i] = new
                grown.append((new, i))
        left = before[i]
        if left >= 0:
            new = pair_rank[left] = get(ids[left] << _SHIFT | rank, -1)
            if new >= 0:
                grown.append((new, left))
        for new, at in grown:
            head = heads[new]
            if head == -1:
                heads[new] = at
                word = new >> 8
                leaves[word] |= bit[new & 255]
                top |= bit[word]
            elif head == -2:
                heappush(several[new], at)
            else:
                heads[new] = -2
                several[new] = [head, at] if head < at else [at, head]
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class _Remembered(dict):
    """Values of ``make`` by key, made when first asked for, in two generations of bounded size."""

    def __init__(self, make, most: int) -> None:
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            self[key] = value
        return value

    def new(self, keys) -> list[str]:
        """Those of the distinct ``keys`` that would be remembered but aren't yet."""
        older = self.older
        return [k for k in keys if k not in self and k not in older and len(k) <= LONGEST]

    def age(self) -> None:
        """Called between documents: what isn't asked for in a whole generation is forgotten."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


#: Just before a single space and a character that isn't white space. No pre-token reaches across: white space
#: before such a space ends a pre-token, and the space begins the next one.
_SEAM = re.compile(r"(?= \S)")
_NO_SEAM = re.compile(r" (?:\s|$)")


class Codec:
    """Encoder and decoder for one vocabulary and one pre-token pattern.

    ``seams``: no match of the pattern goes across a space that is followed by a character other
    than white space, as holds for ``public_tokenizers.PATTERN``. A text is then cut at those
    spaces, and pieces that come again aren't matched again.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, seams: bool = False) -> None:
        self.seams, self.merges = seams, Merges(ranks)
        self.find = regex.compile(pattern).findall
        self.tokens = _Remembered(self._token, REMEMBERED["tokens"])
        self.spans = _Remembered(self._span, REMEMBERED["spans"])
        self.words = _Remembered(lambda word: self._span(" " + word), REMEMBERED["words"])  # each after a space
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.pieces = pa.array(pieces, pa.large_binary())

    def _token(self, token: str) -> bytes:
        ids = encode_piece(token.encode("utf-8", "surrogatepass"), self.merges)
        return _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else np.array(ids, "<u4").tobytes()

    def _span(self, span: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.find(span)))

    def learn(self, words: list[str]) -> None:
        """Remember the new ones of distinct ``words``, each with a space before it; short pre-tokens are encoded together."""
        cut = {x: self.find(" " + x) for x in self.words.new(words)}
        new = self.tokens.new(set(chain.from_iterable(cut.values())))
        pieces = [t.encode("utf-8", "surrogatepass") for t in new]
        self.tokens.update(zip(new, encode_pieces(pieces, self.merges)))
        token = self.tokens.__getitem__
        self.words.update((x, b"".join(map(token, tokens))) for x, tokens in cut.items())

    def _letters(self, tokens: pa.Array) -> pa.Array:
        """The packed ids of different short pre-tokens."""
        edges, data = _bytes_of(tokens.cast(pa.large_binary()))
        packed, cuts = encode_bytes(np.frombuffer(data, np.uint8), np.diff(edges), self.merges)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(tokens), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(packed)])

    def _plain(self, words: pa.Array) -> pa.Array:
        """The packed ids of words of letters that signs may follow."""
        stems = pc.utf8_rtrim(words, _SIGNS)
        edges, data = _bytes_of(words.cast(pa.large_binary()))
        size = edges[1:] - edges[:-1] - np.diff(_bytes_of(stems.cast(pa.large_binary()))[0])
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(edges[1:] - ends[1:], size)
        signs = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(np.frombuffer(data, np.uint8)[at].tobytes()))
        stems, signs = stems.dictionary_encode(), signs.dictionary_encode()
        sign_ids = pa.array([self.spans[x] for x in signs.dictionary.to_pylist()], pa.large_binary()).take(signs.indices)
        return pc.binary_join_element_wise(self._letters(stems.dictionary).take(stems.indices), sign_ids, pa.scalar(b"", pa.large_binary()))

    def _words(self, words: pa.Array) -> pa.Array:
        """The packed ids of different words, each with a space before it."""
        kind, short = pa.large_string(), pc.less_equal(pc.binary_length(words), LONGEST)
        plain = pc.and_(short, pc.utf8_is_alpha(pc.utf8_rtrim(words, _SIGNS))).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        lines = pc.extract_regex(words.take(pa.array(rest)), _TWO_LINES)
        both = pc.and_(lines.is_valid(), short.take(pa.array(rest))).to_numpy(zero_copy_only=False)
        lines = lines.filter(pa.array(both))
        heads = pa.concat_arrays([words.filter(pa.array(plain)), pc.struct_field(lines, "a")])
        heads = pc.binary_join_element_wise(pa.scalar(" ", kind), heads, pa.scalar("", kind))
        ids = self._plain(pa.concat_arrays([heads, pc.struct_field(lines, "b")]))
        n, m = int(plain.sum()), int(both.sum())
        two = pc.binary_join_element_wise(ids.slice(n, m), ids.slice(n + m), pa.scalar(self.spans["\n"], pa.large_binary()))
        others = words.take(pa.array(rest[~both])).to_pylist()
        self.learn(others)
        ids = pa.concat_arrays([ids.slice(0, n), two, pa.array([self.words[x] for x in others], pa.large_binary())])
        return ids.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(plain), rest[both], rest[~both]]))))

    def _split(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts whose every space is a seam: different words are looked up once."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        pieces, starts = parts.flatten(), parts.offsets.to_numpy()
        after_space = np.ones(len(pieces), bool)
        after_space[starts[:-1]] = False
        words = pieces.filter(pa.array(after_space)).dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices)
        edges, data = _bytes_of(ids)
        edges = edges[np.concatenate([[0], np.cumsum(np.diff(starts) - 1)])].tolist()
        first = pieces.take(pa.array(starts[:-1])).to_pylist()
        return [self.spans[x] + data[a:b] for x, a, b in zip(first, edges, edges[1:])]

    def encode_all(self, texts: list[str]):
        """The packed ids of each text."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < AT_ONCE:
                size += len(texts[to])
                to += 1
            plain = [self.seams and not _NO_SEAM.search(t) for t in texts[at:to]]
            split = iter(self._split([t for t, p in zip(texts[at:to], plain) if p]) if any(plain) else ())
            for text, p in zip(texts[at:to], plain):
                yield next(split) if p else self.encode(text)
            for known in (self.tokens, self.spans, self.words):
                known.age()
            at = to

    def encode(self, text: str) -> bytes:
        for known in (self.tokens, self.spans, self.words):
            known.age()
        return b"".join(map(self.spans.__getitem__, _SEAM.split(text) if self.seams else [text]))

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The bytes of each of a large binary array's packed ids."""
        edges, data = _bytes_of(ids)
        decoded, data = _bytes_of(self.pieces.take(pa.array(np.frombuffer(data, "<u4"))))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(decoded[edges // 4].tobytes()), pa.py_buffer(data)])

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all(pa.array([ids], pa.large_binary()))[0].as_py()


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where the values of a large binary array without nulls begin and end, and their bytes."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return np.zeros(1, np.int64), memoryview(b"")
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return offsets - offsets[0], memoryview(data or b"")[offsets[0] : offsets[-1]]


_codecs: dict[tuple, Codec] = {}


def _codec(ranks, pattern: str, key: tuple) -> Codec:
    """One codec a worker process, whatever number of tasks it runs."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern, seams=pattern == _pattern())
    return _codecs[key]


@cache
def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _ranks(spark: SparkSession, path: str):
    ranks = load_ranks(path)
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast(ranks), digest  # a vocabulary: bounded whatever the corpus


def encode_column(spark: SparkSession, text: Column, ranks_path: str, pattern: str | None = None) -> Column:
    """Ids of each whole text as binary: little-endian unsigned 32-bit, without special tokens; null text: empty."""
    common.importable_on_workers(spark)
    ranks, digest = _ranks(spark, ranks_path)
    pattern = pattern or _pattern()

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(ranks, pattern, (digest, pattern))
        # Only so many texts are Python's at a time.
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
        cuts = [0, *(np.flatnonzero(np.diff(sizes // AT_ONCE)) + 1).tolist(), len(texts)]
        parts = (texts.slice(a, b - a).to_pylist() for a, b in zip(cuts, cuts[1:]))
        return pa.concat_arrays([pa.array(codec.encode_all([t or "" for t in part]), pa.binary()) for part in parts])

    return encode(text)


def decode_column(spark: SparkSession, ids: Column, ranks_path: str, pattern: str | None = None) -> Column:
    """Bytes of each array of ids given as ``encode_column`` gives them; null ids: empty."""
    common.importable_on_workers(spark)
    ranks, digest = _ranks(spark, ranks_path)
    pattern = pattern or _pattern()

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        codec = _codec(ranks, pattern, (digest, pattern))
        return codec.decode_all(column.cast(pa.large_binary()).fill_null(b"")).cast(pa.binary())

    return decode(ids)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, and the bytes they decode to.

    Returns (``id_col``, token_ids binary, decoded binary), one row per input row, whatever its
    id (null and repeated ids included). A null text counts as empty: no ids, empty bytes. An
    empty table gives an empty result. Other columns are not read, so their names can't clash.
    Encoding is a projection: nothing is shuffled, and no text is cut however long it is.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col), encode_column(spark, F.col(text_col), ranks_path, pattern).alias("token_ids"))
    return ids.select(id_col, "token_ids", decode_column(spark, F.col("token_ids"), ranks_path, pattern).alias("decoded"))


def digest(docs: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``."""
    coded = round_trip(docs, ranks_path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
