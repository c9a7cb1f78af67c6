"""Streams: first arrivals of content, arrivals by time, and decisions that follow clicks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.review import FOLDED, click, merged_rows
from ..operators.state import importable_on_workers


def first_arrivals(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Arrivals (columns content_hash, arrived) without those whose content came before within ``late``.

    The state holds hashes for ``late`` only, so it doesn't grow with the library.
    """
    return files.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["content_hash"])


def arrivals_by_window(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, kind, n, bytes) of arrivals in tumbling windows."""
    timed = files.withWatermark("arrived", late).groupBy(F.window("arrived", window), "kind")
    return timed.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("window.start", "window.end", "kind", "n", "bytes")


def follow_clicks(clicks: DataFrame) -> DataFrame:
    """Decisions of each group after every batch of clicks.

    Clicks: group_id, seq, file_id, action, files (all ids of the group). Output rows as in ``FOLDED``,
    the whole group's each time it changes.
    """
    importable_on_workers(clicks.sparkSession)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, kinds, donor = state.get if state.exists else ([], [], None)
        decisions = dict(zip(ids, kinds))
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            for f in row.files:
                decisions.setdefault(int(f), "")
            donor = click(decisions, donor, int(row.file_id), row.action)
        state.update((list(decisions), list(decisions.values()), donor))
        yield pd.DataFrame(merged_rows(key[0], decisions, donor), columns=["group_id", "file_id", "decision", "merge_from_file_id"])

    kept = "ids array<bigint>, decisions array<string>, donor bigint"
    return clicks.groupBy("group_id").applyInPandasWithState(follow, FOLDED, kept, "update", GroupStateTimeout.NoTimeout)
