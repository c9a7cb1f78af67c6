"""Hamming links between 64-bit hashes, and the connected components that they make."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hamming
from . import metric
from .state import checkpoint


def _block(h: Column, first: int, n: int) -> Column:
    return h if n == 64 else F.shiftrightunsigned(h, first).bitwiseAND((1 << n) - 1)


#: The widest radius for which keys of bits tell hashes apart well; beyond it, a metric tree does better.
KEYED = 8


def _keys(radius: int) -> list[list[tuple[int, int]]]:
    """The keys of a hash, each two blocks (first bit, bits): hashes within the radius agree in one key at least.

    Of radius + 2 blocks two agree, whichever bits differ (21 keys of 18 bits for a radius of 5).
    """
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    spans = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]
    return [list(key) for key in combinations(spans, 2)]


def hamming_links(hashes: DataFrame, radius: int, column: str = "h", parts: int = 8) -> DataFrame:
    """(a, b, distance), a < b: pairs of different hashes at most ``radius`` bits apart, each once.

    Hashes that are equal are one. Up to ``KEYED`` bits, an equi-join on the keys of ``_keys`` finds every pair; a pair is
    reported by the first key in which it agrees, so nothing has to be made distinct. Each key's rows on the one side
    are dealt to ``parts`` tasks, and meet the other side's in all of them, so a hot key is no one task's work. Beyond,
    the hashes are searched by a metric tree (``metric.searched``).
    """
    if radius > KEYED:
        return metric.searched(hashes, radius, column).where("a IS NOT NULL").select("a", "b", "distance")
    h = hashes.select(F.col(column).alias("h")).where(F.col(column).isNotNull()).distinct()
    distance = hamming(F.col("a"), F.col("b"))
    keys = _keys(radius)

    def bits(key: list[tuple[int, int]]) -> Column:
        found = F.lit(0).cast("long")
        for first, n in key:
            found = F.shiftleft(found, n).bitwiseOR(_block(F.col("h"), first, n)) if n < 64 else F.col("h")
        return found

    listed = F.array(*(F.struct(F.lit(i).alias("i"), bits(key).alias("bits")) for i, key in enumerate(keys)))
    keyed = h.select("h", F.explode(listed).alias("k")).select("h", "k.i", "k.bits")
    left = keyed.select(F.col("h").alias("a"), "i", "bits", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int").alias("part"))
    right = keyed.select(F.col("h").alias("b"), F.col("i").alias("j"), F.col("bits").alias("same"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("dealt"))
    first = F.lit(-1)
    for i, key in reversed(list(enumerate(keys))):
        mask = sum(((1 << n) - 1) << at for at, n in key)
        first = F.when(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(mask - 2**64 if mask >= 2**63 else mask) == 0, i).otherwise(first)
    met = (F.col("i") == F.col("j")) & (F.col("bits") == F.col("same")) & (F.col("part") == F.col("dealt"))
    pair = met & (F.col("a") < F.col("b")) & (distance <= radius) & (F.col("i") == first)
    return left.join(right, pair).select("a", "b", distance.alias("distance"))


def hamming_components(hashes: DataFrame, radius: int, column: str = "h") -> DataFrame:
    """(node, component): the smallest hash that links of at most ``radius`` bits lead to, for every hash.

    Beyond ``KEYED`` bits tasks pass on forests of the links that they find, so what is joined grows with the hashes, not with the links.
    """
    nodes = hashes.select(F.col(column).alias("node")).where("node IS NOT NULL")
    if radius > KEYED:
        links = metric.searched(nodes, radius, "node", forest=True).where("a IS NOT NULL")
    else:
        links = hamming_links(nodes, radius, "node")
    return components(links, nodes)


def components(links: DataFrame, nodes: DataFrame | None = None, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links lead to. ``nodes`` (column ``node``) adds those without links.

    Large-star and small-star rounds; each round's edges go to the checkpoint folder, so the plan
    stays short and a lost executor costs one round at most.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = checkpoint(edges), None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not state[0] or state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    told = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    told = told.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return told
    return nodes.select("node").distinct().join(told, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
