"""Perceptual hashes of grey values: the signs of low frequencies against their median."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.state import importable_on_workers

#: Rows and columns of the grey values that a picture is scaled to, and of the frequencies that are kept.
SIDE, KEPT = 32, 8


def cosines(n: int) -> np.ndarray:
    """The matrix of the discrete cosine transform (type II, not scaled) of ``n`` values: a row for each frequency."""
    return 2 * np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(n) + 1) / (2 * n))


def hashes(grey: np.ndarray) -> np.ndarray:
    """64 bits for each of some square pictures, an array of (pictures, rows, columns).

    The transform is taken along columns, then rows. Of the ``KEPT`` by ``KEPT`` lowest frequencies, row by row, each is a
    bit, the highest first: 1 if it is over the median of them all.
    """
    low = cosines(grey.shape[1])[:KEPT]
    freq = np.einsum("ui,nij,vj->nuv", low, grey.astype(float), low, optimize=True).reshape(len(grey), -1)
    bits = freq > np.median(freq, axis=1, keepdims=True)
    return (bits.astype(np.uint64) << np.arange(KEPT * KEPT - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def hex_hashes(grey: np.ndarray) -> list[str]:
    return [f"{h:016x}" for h in hashes(grey).tolist()]


def hash_column(grey: Column, side: int) -> Column:
    """The hash in hex of an array of ``side`` * ``side`` grey values, row by row; null for an array that is null, shorter, longer, or has a null."""
    importable_on_workers(SparkSession.active())

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(values), dtype=object, index=values.index)
        whole = [k for k, v in values.items() if v is not None and len(v) == side * side and not pd.isna(v).any()]
        if whole:
            out[whole] = hex_hashes(np.stack([values[k] for k in whole]).reshape(-1, side, side))
        return out

    return run(grey)
