"""Structured Streaming forms of the windows."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def anchored_counts(events: DataFrame, time: Column, key: Column, seq: Column, width: int, absolute: bool = False, scope: Column | None = None) -> DataFrame:
    """Counts per key of anchored windows, emitted when an event closes the window: (scope, window_start, key, count).

    Events of a micro-batch are taken in ``seq`` order. A late event stays in the open window; with ``absolute`` one
    that is ``width`` or more too old closes it as well. State per scope: the start and the open window's counts.
    """
    rows = events.select((F.lit("") if scope is None else scope.cast("string")).alias("scope"), time.cast("long").alias("t"), key.cast("string").alias("key"), seq.cast("long").alias("seq"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, counts = (state.get[0], Counter(json.loads(state.get[1]))) if state.exists else (None, Counter())
        out: list[tuple] = []
        for t, k in pd.concat(list(batches)).sort_values("seq", kind="stable")[["t", "key"]].itertuples(index=False):
            if start is not None and ((abs(t - start) if absolute else t - start) >= width):
                out += [(group[0], start, name, n) for name, n in sorted(counts.items())]
                start, counts = t, Counter()
            start = t if start is None else start
            counts[k] += 1
        state.update((start, json.dumps(counts)))
        yield pd.DataFrame(out, columns=["scope", "window_start", "key", "count"])

    return rows.groupBy("scope").applyInPandasWithState(
        step, "scope string, window_start long, key string, count long", "start long, counts string", "append", GroupStateTimeout.NoTimeout
    )


def sliding_load(events: DataFrame, time: str, key: str, task: str, size: str = "30 minutes", slide: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sliding load with a watermark; distinct keys by sketch, since exact distinct counts do not stream."""
    text = F.col(key).cast("string")
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w"), task).agg(
        F.count("*").alias("tuples"), F.sum(F.octet_length(text)).alias("bytes"), F.approx_count_distinct(text, 0.02).alias("keys")
    ).select(F.col("w.start").alias("window_start"), task, "tuples", "bytes", "keys")
