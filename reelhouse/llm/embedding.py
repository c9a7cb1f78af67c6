"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Unit vectors with cosine c are sqrt(2 - 2c) apart, and their projections on a Gaussian direction
differ by a normal variable with that deviation. Two vectors collide in a projection when the one
lies in the window centred on the other. Over ``COUNTED`` projections, the number of collisions of a
pair at the cosine asked for is binomial; pairs with at least as many as all but ``MISS`` of such
pairs have are verified with their cosine in double precision.

To count for pairs that can collide at all, vectors are first dealt out by ``tables`` of ``depth``
further projections cut into cells. ``depth`` grows with the logarithm of the number of vectors, so a
cell holds about as many however large the table is, and ``tables`` is set so that a pair at the
cosine asked for shares a cell with probability 1 - ``MISS``. Within a cell, rows are sorted by the
first counted projection and each row's neighbours in it are found by bisection, in a window so wide that it
loses no more than ``MISS`` of the pairs asked for; the narrower window of the counts comes after that. A cell with more than
``HOT_CELL`` rows is compared in blocks of pairs of its parts, in tasks of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COSINE = 0.98
COUNTED = 32
MISS = 0.0005
HOT_CELL = 4096
#: Vectors expected in a cell.
IN_CELL = 16

#: Width of a cell, and half a window's, in deviations of a projection's difference at the cosine asked for.
_CELL, _HALF = 7.5, 2.0
#: Half the window of the sorted projection: a normal variable is beyond it with probability 0.0005.
_SORTED = 3.5
_STEPS = 24  # of the quantised projections in a deviation of a unit vector's


@dataclass(frozen=True)
class Plan:
    """The index's shape, from the cosine asked for and the number of vectors alone."""

    deviation: float
    depth: int
    tables: int
    window: int  # half, in quantised steps
    collisions: int
    reach: int  # half the sorted projection's window, in quantised steps

    @classmethod
    def of(cls, vectors: int, cosine: float, miss: float = MISS) -> Plan:
        deviation = math.sqrt(2 - 2 * cosine)
        width = _CELL * deviation
        together = 1 - math.sqrt(2 / math.pi) / _CELL  # in a cell, at the cosine asked for
        grid = np.linspace(-width, width, 2001)
        apart = np.exp(-(grid**2) / 4) / math.sqrt(4 * math.pi)
        chance = float(((1 - np.abs(grid) / width) * apart).sum() * (grid[1] - grid[0]))  # of unrelated vectors
        depth = max(2, math.ceil(math.log(max(2, vectors / IN_CELL)) / -math.log(chance)))
        tables = max(1, math.ceil(math.log(miss) / math.log1p(-(together**depth))))
        p = math.erf(_HALF / math.sqrt(2))
        below, collisions = 0.0, 0
        while (below := below + math.comb(COUNTED, collisions) * p**collisions * (1 - p) ** (COUNTED - collisions)) < miss:
            collisions += 1
        window, reach = (math.ceil(half * deviation * _STEPS) + 1 for half in (_HALF, _SORTED))
        return cls(deviation, depth, tables, window, collisions, reach)


def _cells(plan: Plan):
    """Each vector once for each table: the cell's key, the vector's class, its quantised projections and all its keys."""

    def run(batches):
        directions: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                part = batch.take(pa.array(rows))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if d not in directions:
                    rng = np.random.default_rng(d)
                    n = COUNTED + plan.tables * plan.depth
                    directions[d] = rng.normal(size=(d, n)), rng.uniform(size=plan.tables * plan.depth)
                lines, shifts = directions[d]
                on = x @ lines
                sketch = np.clip(np.rint(on[:, :COUNTED] * _STEPS), -127, 127).astype(np.int8)
                cell = np.floor(on[:, COUNTED:] / (_CELL * plan.deviation) + shifts).astype(np.int64).astype(np.uint64)
                keys = np.zeros((len(x), plan.tables), np.uint64)
                salt = np.arange(plan.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                keys += salt + np.uint64(d) + part.column("label").cast(pa.int64()).to_numpy().astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95)
                for i in range(plan.depth):
                    keys ^= keys >> np.uint64(29)
                    keys *= np.uint64(0xBF58476D1CE4E5B9)
                    keys += cell[:, i :: plan.depth]
                keys ^= keys >> np.uint64(32)
                keys *= np.uint64(0x94D049BB133111EB)
                at = np.repeat(np.arange(len(x)), plan.tables)
                short = (keys >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(keys.reshape(-1).view(np.int64)),
                        "cls": part.column("cls").take(pa.array(at)),
                        "t": pa.array(np.tile(np.arange(plan.tables, dtype=np.int32), len(x))),
                        "sketch": pa.array([s.tobytes() for s in sketch], pa.binary()).take(pa.array(at)),
                        "keys": pa.array([s.tobytes() for s in short], pa.binary()).take(pa.array(at)),
                    }
                )

    return run


def _count(plan: Plan):
    """Pairs of a cell with enough collisions, each from the first table whose cells hold both."""

    def pairs(cls, t, part, sketch, keys):
        order = np.argsort(sketch[:, 0], kind="stable")
        cls, part, sketch, keys = cls[order], part[order], sketch[order], keys[order]
        first = sketch[:, 0]
        ends = np.searchsorted(first, first + plan.reach, side="right")
        crossed = part.max() != part.min()  # a block of two parts of a hot cell: pairs within a part are found elsewhere
        for i in range(len(cls)):
            near = slice(i + 1, ends[i])
            hits = (np.abs(sketch[near] - sketch[i]) <= plan.window).sum(axis=1) >= plan.collisions
            at = i + 1 + np.flatnonzero(hits)
            if crossed:
                at = at[part[at] != part[i]]
            if t and len(at):
                at = at[~(keys[at, :t] == keys[i, :t]).any(axis=1)]
            yield from zip((cls[i],) * len(at), cls[at])

    def run(batches):
        for table in common.whole_groups(batches):
            table = table.combine_chunks()
            group = table.column("key").to_numpy()
            edges = np.flatnonzero(np.diff(group)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(group)]])
            cls, t, part = (table.column(c).to_numpy() for c in ("cls", "t", "part"))
            found = []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                rows = table.slice(a, b - a)
                sketch, keys = (b"".join(rows.column(c).to_pylist()) for c in ("sketch", "keys"))
                sketch = np.frombuffer(sketch, np.int8).reshape(b - a, -1).astype(np.int16)
                keys = np.frombuffer(keys, np.uint32).reshape(b - a, -1)
                found += pairs(cls[a:b], int(t[a]), part[a:b], sketch, keys)
                if len(found) > 100_000:
                    yield _pairs(found)
                    found = []
            yield _pairs(found)

    return run


def _pairs(found: list) -> pa.RecordBatch:
    ab = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def candidates(classes: DataFrame, cosine: float, hot_cell: int = HOT_CELL) -> DataFrame:
    """(a, b): pairs of classes that collide often enough. ``classes``: (cls long, label integer, v array<double>)."""
    common.importable_on_workers(classes.sparkSession)
    plan = Plan.of(classes.count(), cosine)
    cells = classes.mapInArrow(_cells(plan), "key bigint, cls bigint, t int, sketch binary, keys binary")
    cells = common.checkpoint(cells)
    hot = cells.groupBy("key").count().where(F.col("count") > hot_cell)
    hot = hot.select(F.col("key").alias("hot"), F.ceil(F.col("count") / hot_cell).cast("int").alias("parts"))
    dealt = cells.join(hot, cells["key"] == hot["hot"], "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("cls"), F.col("parts"))).cast("int")
    dealt = dealt.withColumn("part", part)
    others = F.when(F.col("parts").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.expr("sequence(0, parts - 1)"))
    dealt = dealt.withColumn("other", F.explode(others))
    blocked = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    key = F.when(F.col("other").isNull(), F.col("key")).otherwise(blocked)
    dealt = dealt.select(key.alias("key"), "cls", "t", "part", "sketch", "keys")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_count(plan), "a bigint, b bigint").distinct()


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """(``id_col``, n_links, component_id, kept), one row per input row.

    Links join vectors of the same length and the same label whose cosine is at least ``cosine``.
    Rows with a null id or label, and vectors that are null, empty, zero or hold null or non-finite
    components link with nothing: no links, their own id as component, kept. Equal vectors of a
    label are one class: compared once, and counted as often as they come, repeated rows included.
    An empty table gives an empty result. Other columns aren't read.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~odd
    valid = valid & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    good = rows.where("valid")
    classes = good.groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # A class has a number of its own: ids need not be unique. The numbers hold once the table is written.
    # So is the largest component, which the optimizer would else put into the loop over all components.
    largest = F.array_max(F.transform("v", lambda x: F.abs(x))).alias("largest")
    classes = common.checkpoint(classes.select("*", F.monotonically_increasing_id().alias("cls"), largest))
    indexed = classes.select("cls", F.xxhash64("label").alias("label"), "v")
    pairs = candidates(indexed, cosine)
    # Components of at most 1, the largest of them 1: no square or sum of them can overflow, and no norm is 0.
    scaled = classes.withColumn("s", F.transform("v", lambda x: x / F.col("largest")))
    sized = scaled.select("cls", F.col("s").alias("v"), "n", "label", F.sqrt(_dot(F.col("s"), F.col("s"))).alias("norm"))
    a = sized.select(*(F.col(c).alias(f"a_{c}") for c in sized.columns))
    b = sized.select(*(F.col(c).alias(f"b_{c}") for c in sized.columns))
    both = pairs.join(a, F.col("a") == F.col("a_cls")).join(b, F.col("b") == F.col("b_cls"))
    alike = (F.col("a_label") == F.col("b_label")) & (F.size("a_v") == F.size("b_v"))
    value = _dot(F.col("a_v"), F.col("b_v")) / F.col("a_norm") / F.col("b_norm")
    links = common.checkpoint(both.where(alike & (value >= cosine)).select("a", "b", "a_n", "b_n"))
    halves = links.select(F.col("a").alias("cls"), F.col("b_n").alias("m")).unionByName(
        links.select(F.col("b").alias("cls"), F.col("a_n").alias("m"))
    )
    linked = halves.groupBy("cls").agg(F.sum("m").alias("m"))
    joined = common.connected_components(links, "a", "b").withColumnRenamed("node", "cls")
    told = classes.join(linked, "cls", "left").join(joined, "cls", "left")
    told = told.withColumn("root", F.coalesce("component", "cls"))
    least = told.groupBy("root").agg(F.min("first").alias("component_id"))
    told = told.join(least, "root").select(
        F.col("label").alias("l"),
        F.col("v").alias("w"),
        (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        "component_id",
    )
    out = rows.join(told, F.col("valid") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE scaled AS (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]),
    lambda x: x / list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda y: abs(y)))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), v AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM scaled
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), n AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a
JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON e.vec_id = c.node
"""
