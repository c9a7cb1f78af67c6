"""Hamming links by a metric tree: hashes are dealt by their distances to vantage points, and subtrees are searched apart.

A node of the tree has a vantage point and a radius. Hashes within the radius go to its inner child, the others to its
outer one. By the triangle inequality a hash has neighbours within ``r`` in the inner child only if it lies no more than
``r`` outside the radius, and in the outer child only if it lies less than ``r`` inside. So each hash has one leaf, its
home, and visits the later leaves in which it can have neighbours. A leaf's task compares those at home with each other,
and the visitors with those at home, by a small tree of its own with the same bounds.

Trees are made on samples, a complete tree of ``DEPTH`` levels at a time for every node that has too many hashes
at home, until none has or splitting no longer helps. The sample decides where a hash is looked for, never whether a
pair is found. A leaf with many visitors, or many at home that can't be told apart by distances, is dealt out to
several tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hamming
from .state import checkpoint, importable_on_workers

#: Hashes at home in a leaf, and visitors of a task; levels of the trees that are made at a time; hashes of a node's sample, about.
#: A leaf's links are held by its task, so leaves are small where all are listed; where a forest of them is enough, larger leaves make fewer visits.
LEAF, VISITORS, DEPTH, SAMPLE = 1 << 12, 1 << 13, 5, 2048
FOREST_LEAF = 1 << 15
#: Hashes that are compared with each other without a further vantage point, and the share of comparisons that one must leave at most.
_FEW, WORTH = 48, 0.99

PAIRS = "a bigint, b bigint, distance int, compared bigint"
_TREES = "node string, vantage array<bigint>, radius array<int>"


def _distances(hashes: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(hashes ^ vantage)


def _cut(d: np.ndarray, radius: int, least: int = 1) -> tuple[int, float]:
    """The distance at which to part hashes, and the share of comparisons that is left; ``least`` on each side at least.

    Left are those within both sides, and those of hashes near the border with each other. The latter count twice, as sides
    are parted further, but what lies across a border hardly gets less.
    """
    n = len(d)
    upto = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=65))])  # upto[k]: hashes nearer than k
    cut = np.arange(64)
    inner, outer = upto[cut + 1], n - upto[cut + 1]
    shells = (inner - upto[np.maximum(cut + 1 - radius, 0)]) * (upto[np.minimum(cut + radius + 1, 65)] - inner)
    left = (inner.astype(float) ** 2 + outer.astype(float) ** 2 + 4.0 * shells) / n**2
    left[(inner < least) | (outer < least)] = np.inf
    # Of cuts that are alike, the one nearest to the median.
    best = int(np.argmin(left + np.abs(inner / n - 0.5) * 1e-3))
    return best, float(left[best])


def _fit(node: str, hashes: np.ndarray, radius: int, most: float) -> tuple[str, list[int], list[int]]:
    """A complete tree in the order of a heap. A node with no more than ``most`` of the sample isn't parted: all is inside."""
    size = (1 << DEPTH) - 1
    vantage, radii = [0] * size, [128] * size
    held = {0: hashes}
    for k in range(size):
        own = held.pop(k, hashes[:0])
        if len(own) <= max(1, most):
            held[2 * k + 1] = own
            continue
        # Of a few vantage points, the one that leaves the fewest comparisons.
        tried = own[:: max(1, len(own) // 8)][:8]
        at = min(tried, key=lambda v: _cut(_distances(own, v), radius, max(1, len(own) // 8))[1])
        d = _distances(own, at)
        cut, left = _cut(d, radius, max(1, len(own) // 8))
        if np.isinf(left):
            cut = int(np.median(d))
            cut = cut if (d > cut).any() else cut - 1
        vantage[k], radii[k] = int(at.astype(np.int64)), cut
        held[2 * k + 1], held[2 * k + 2] = own[d <= cut], own[d > cut]
    return node, vantage, radii


def _fitted(radius: int, leaf: int):
    def run(samples: pa.Table) -> pa.Table:
        most = samples.num_rows * leaf / samples["n"][0].as_py()
        node, vantage, radii = _fit(samples["node"][0].as_py(), np.sort(samples["h"].to_numpy()).view(np.uint64), radius, most)
        return pa.table({"node": [node], "vantage": pa.array([vantage], pa.list_(pa.int64())), "radius": pa.array([radii], pa.list_(pa.int32()))})

    return run


def _at(values: str, k: Column) -> Column:
    return F.get(F.col(values), k)


def _home() -> Column:
    """The heap's place of the leaf where ``h`` is at home."""
    far = lambda k: hamming(F.col("h"), _at("vantage", k)) > _at("radius", k)
    return reduce(lambda k, _: 2 * k + F.when(far(k), 2).otherwise(1), range(DEPTH), F.lit(0))


def _visited(radius: int) -> Column:
    """The places of all leaves that can hold neighbours of ``h``."""

    def below(k: Column) -> Column:
        d = hamming(F.col("h"), _at("vantage", k))
        inner = F.when(d <= _at("radius", k) + radius, 2 * k + 1)
        outer = F.when(d > _at("radius", k) - radius, 2 * k + 2)
        return F.array(inner, outer)

    return reduce(lambda ks, _: F.filter(F.flatten(F.transform(ks, below)), lambda k: k.isNotNull()), range(DEPTH), F.array(F.lit(0)))


def _routed(rows: DataFrame, trees: DataFrame, radius: int) -> DataFrame:
    """(node, h, home): rows of nodes that have a tree, dealt to its leaves; what has its home here visits only later leaves."""
    both = rows.join(trees, "node")
    both = both.withColumn("at", F.when(F.col("home"), _home()))
    leaves = F.filter(_visited(radius), lambda k: ~F.col("home") | (k >= F.col("at")))
    both = both.select("node", "h", "home", "at", F.explode(leaves).alias("leaf"))
    child = F.concat("node", F.lit("/"), F.lpad(F.col("leaf").cast("string"), 3, "0"))
    return both.select(child.alias("node"), "h", (F.col("home") & (F.col("leaf") == F.col("at"))).alias("home"))


def _cross(homes: np.ndarray, visitors: np.ndarray, radius: int, found: list) -> int:
    """Append (home, visitor, distance) of all pairs within the radius to ``found``; the number of comparisons."""
    done, left = 0, [(homes, visitors)]
    while left:
        homes, visitors = left.pop()
        if not len(homes) or not len(visitors):
            continue
        if len(homes) > _FEW:
            at = homes[len(homes) // 2]
            d = _distances(homes, at)
            cut, share = _cut(d, radius, max(1, len(homes) >> 7))
            done += len(homes)
            if share < WORTH:
                there = _distances(visitors, at).astype(np.int16)
                done += len(visitors)
                for side in (d <= cut, d > cut):
                    low, high = int(d[side].min()), int(d[side].max())
                    left.append((homes[side], visitors[(there >= low - radius) & (there <= high + radius)]))
                continue
        step = max(1, (1 << 20) // len(homes))
        for k in range(0, len(visitors), step):
            d = np.bitwise_count(homes[:, None] ^ visitors[None, k : k + step])
            i, j = np.nonzero(d <= radius)
            found.append((homes[i], visitors[k + j], d[i, j]))
        done += len(homes) * len(visitors)
    return done


def _among(homes: np.ndarray, radius: int, found: list) -> int:
    """As ``_cross``, of all pairs of ``homes``, each once."""
    done, left = 0, [homes]
    while left:
        homes = left.pop()
        if len(homes) <= _FEW:
            i, j = np.triu_indices(len(homes), 1)
            d = np.bitwise_count(homes[i] ^ homes[j])
            near = d <= radius
            found.append((homes[i[near]], homes[j[near]], d[near]))
            done += len(i)
            continue
        d = _distances(homes, homes[len(homes) // 2])
        cut, share = _cut(d, radius, max(1, len(homes) >> 7))
        done += len(homes)
        if share < WORTH:
            inner, outer = d <= cut, d > cut
            low, high = int(d[outer].min()), int(d[inner].max())
            left += [homes[inner], homes[outer]]
            done += _cross(homes[inner & (d >= low - radius)], homes[outer & (d <= high + radius)], radius, found)
        else:
            half = len(homes) // 2
            left += [homes[:half], homes[half:]]
            done += _cross(homes[:half], homes[half:], radius, found)
    return done


class _Forest:
    """Takes links as a list does, and keeps those that join two trees of what was kept before."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes, self.kept = np.unique(hashes), []
        self.parent = list(range(len(self.hashes)))

    def _root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def append(self, links: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        if not len(links[0]):
            return
        a, b = (np.searchsorted(self.hashes, links[k]) for k in (0, 1))
        root = np.array(self.parent)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
        kept = []
        for k in np.flatnonzero(root[a] != root[b]).tolist():
            p, q = self._root(int(a[k])), self._root(int(b[k]))
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                kept.append(k)
        self.kept.append(tuple(x[kept] for x in links))


def _search(radius: int, forest: bool):
    def run(table: pa.Table) -> pa.Table:
        h, role = table["h"].to_numpy().view(np.uint64), table["role"].to_numpy()
        found = _Forest(h) if forest else []
        homes, others = np.sort(h[role == 0]), np.sort(h[role == 1])
        done = _cross(homes, others, radius, found) if table["job"][0].as_py() else _among(homes, radius, found)
        kept = found.kept if forest else found
        x, y, d = (np.concatenate([f[k] for f in kept]) if kept else np.zeros(0, np.uint64) for k in range(3))
        x, y = x.view(np.int64), y.view(np.int64)
        columns = np.minimum(x, y), np.maximum(x, y), d.astype(np.int32)
        kinds = (pa.int64(), pa.int64(), pa.int32())
        arrays = [pa.concat_arrays([pa.array(c, k), pa.nulls(1, k)]) for c, k in zip(columns, kinds)]
        return pa.table([*arrays, pa.array([None] * len(x) + [done], pa.int64())], names=["a", "b", "distance", "compared"])

    return run


def _leaves(hashes: DataFrame, radius: int, column: str, leaf: int) -> DataFrame:
    """(node, h, home): each hash at home in one leaf, and in all later leaves that can hold its neighbours."""
    h = hashes.select(F.col(column).alias("h")).where(F.col(column).isNotNull()).distinct()
    rows = checkpoint(h.select(F.lit("").alias("node"), "h", F.lit(True).alias("home")))
    done, parents = [], None
    while True:
        sizes = rows.where("home").groupBy("node").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > leaf)
        if parents is not None:
            # A node that holds nearly all of its parent isn't parted again.
            known = parents.select(F.col("node").alias("_parent"), F.col("n").alias("_n"))
            large = large.join(known, F.regexp_replace("node", "/[^/]*$", "") == F.col("_parent")).where(F.col("n") < 0.9 * F.col("_n"))
        large = checkpoint(large.select("node", "n"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        drawn = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) * F.col("n") <= (1 << 30) * SAMPLE
        sample = rows.where("home").join(large, "node").where(drawn).select("node", "n", "h")
        trees = checkpoint(sample.groupBy("node").applyInArrow(_fitted(radius, leaf), _TREES))
        done.append(rows.join(trees.select("node"), "node", "left_anti"))
        rows, parents = checkpoint(_routed(rows, trees, radius)), large


def searched(
    hashes: DataFrame, radius: int, column: str = "h", forest: bool = False, leaf: int | None = None, visitors: int = VISITORS
) -> DataFrame:
    """Rows of ``PAIRS``: all pairs of different hashes within the radius, a < b, each once.

    ``forest``: of the pairs that a task finds, only those that join what isn't joined yet, which is enough for
    components. Rows without ``a`` and ``b`` tell how many comparisons a task made. Null hashes are left out, equal ones are one.
    """
    importable_on_workers(hashes.sparkSession)
    leaf = leaf or (FOREST_LEAF if forest else LEAF)
    leaves = _leaves(hashes, radius, column, leaf)
    counts = leaves.groupBy("node").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).where("homes > 0")
    blocks = F.ceil(F.col("homes") / leaf).cast("int").alias("p"), F.ceil(F.col("guests") / visitors).cast("int").alias("q")
    dealt = leaves.join(checkpoint(counts.select("node", *blocks)), "node")
    # Jobs of a leaf: 0, block i at home with itself; 1, with a later block j; 2, with block j of the visitors.
    own, guest = F.pmod(F.xxhash64("h"), F.col("p")).cast("int"), F.pmod(F.xxhash64("h"), F.col("q")).cast("int")

    def job(kind: Column | int, i: Column, j: Column, role: Column | int) -> Column:
        kind, role = (v if isinstance(v, Column) else F.lit(v) for v in (kind, role))
        return F.struct(kind.alias("job"), i.alias("i"), j.alias("j"), role.alias("role"))

    def each(n: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.col(n)), lambda k: k < F.col(n))

    among = F.transform(each("p"), lambda k: job(F.when(k == own, 0).otherwise(1), F.least(own, k), F.greatest(own, k), F.when(k < own, 1).otherwise(0)))
    met = F.transform(each("q"), lambda k: job(2, own, k, 0))
    visits = F.transform(each("p"), lambda k: job(2, k, guest, 1))
    jobs = F.when(F.col("home"), F.concat(among, met)).otherwise(visits)
    rows = dealt.select("node", "h", F.explode(jobs).alias("to")).select("node", "h", "to.*")
    return rows.groupBy("node", "job", "i", "j").applyInArrow(_search(radius, forest), PAIRS)
