"""What the corpus operators share: reading, checkpoints, Arrow text buffers and connected components."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text for which numpy work arrays are held at a time (a longer document is taken alone).
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def importable_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when they start in another directory than the driver."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


#: Whether Spark removes a query's shuffle files when the query ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Whether the optimizer deduces conditions on columns from those that are given.
_DEDUCE = "spark.sql.constraintPropagation.enabled"


def checkpoint(df: DataFrame, plain: bool = False) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and continue from there.

    The folder is the one in ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) a temporary folder is taken. Nothing reads the shuffle files behind a checkpoint
    again, so Spark is told to remove them at once. ``plain``: no conditions go with the result; those of
    unions of different plans can name columns that aren't there, and the next checkpoint fails.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if configured is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    wanted = {_TIDY: "true"} | ({_DEDUCE: "false"} if plain else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spare_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name (in either case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets at which they begin and end; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES):
    """(first row, data, offsets) of consecutive rows of at most ``chunk_bytes`` together, or one longer row."""
    data, offsets = text_buffers(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + chunk_bytes, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges``; component is the smallest node reachable.

    Distributed union-find by alternating large-star and small-star rounds: each round is a few
    hash aggregations and joins over the edges that are left, and every round's edges go to the
    checkpoint folder. Rows with a null end and loops are ignored, repeated edges count once.
    Nothing is gathered on the driver but an edge count and a checksum.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = checkpoint(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or state == before:
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
    # Settled: every edge joins a node with the smallest of its component.
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def whole_groups(batches):
    """Tables of whole groups from record batches whose rows are sorted by their first column, a long.

    Only the last group of what has come so far is held back, as it may go on in the next batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and keys[0] != held[-1].column(0)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
