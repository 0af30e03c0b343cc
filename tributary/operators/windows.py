"""Tumbling windows anchored on the data, and sliding load statistics.

An anchored window starts at an event and closes when an event comes at least ``width`` after that start; the
closing event starts the next one. Each start needs the one before, so finding them is a chain. The chain is cut
into blocks that are summed up side by side: for each start that may be open when a block begins, where the chain
leaves the block and how many windows it opened. One short fold joins the blocks, and each block then lists its
own starts. No task holds more than one block, and the fold reads summaries only: per block at most the distinct
times of one ``width``, fewer where chains from different entries run into each other.

``anchored`` takes events in time order (blocks of the time line), ``anchored_arrivals`` in order of arrival, where
times may go back. Events without time, or without number of arrival, are in no window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths in a block of the time line; arrivals in a block of the stream.
CELLS, ARRIVALS = 64, 1 << 16


def _closes(t: np.ndarray, start: int, width: int, absolute: bool) -> np.ndarray:
    return (np.abs(t - start) if absolute else t - start) >= width


def _next(t: np.ndarray, width: int, absolute: bool) -> np.ndarray:
    """For each event the position of the event that closes a window started by it; the length if none does.

    Extremes of runs of 2^k events, skipped from the longest to the shortest while they close nothing.
    """
    n = len(t)
    highs, lows = [t], [t]
    while 2 << len(highs) - 1 <= n:
        half = 1 << len(highs) - 1
        highs.append(np.maximum(highs[-1][:-half], highs[-1][half:]))
        lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
    at = np.arange(1, n + 1)
    for k in reversed(range(len(highs))):
        run = np.minimum(at, n - (1 << k))  # where it does not fit it is not skipped
        skip = (at + (1 << k) <= n) & (highs[k][run] < t + width)
        if absolute:
            skip &= lows[k][run] > t - width
        at = at + np.where(skip, 1 << k, 0)
    return at


def _pieces(t: np.ndarray, prior: int | None, width: int, absolute: bool) -> list[tuple]:
    """(lo, hi, exit, opened): an open start within lo..hi leaves the block as ``exit`` after ``opened`` new windows.

    Starts in no piece stay open. ``prior`` is the time of the event before the block, which bounds the open start.
    """
    n, nxt = len(t), _next(t, width, absolute)
    last, opened = np.arange(n), np.ones(n, np.int64)
    for i in range(n - 2, -1, -1):
        if nxt[i] < n:
            last[i], opened[i] = last[nxt[i]], opened[nxt[i]] + 1
    if prior is None:  # the first event of all opens the first window
        return [(0, 0, int(t[last[0]]), int(opened[0]))]
    lo, hi = prior - width + 1, (prior + width - 1 if absolute else np.iinfo(np.int64).max // 4)
    out: list[tuple] = []
    for low, high, i in zip((t - width).tolist(), (t + width).tolist(), range(n)):
        if low >= lo:  # starts up to ``low`` close here
            out.append((lo, min(low, hi), int(t[last[i]]), int(opened[i])))
            lo = low + 1
        if absolute and high <= hi:
            out.append((max(high, lo), hi, int(t[last[i]]), int(opened[i])))
            hi = high - 1
        if lo > hi:
            break
    merged: list[tuple] = []
    for piece in sorted(p for p in out if p[0] <= p[1]):
        if merged and merged[-1][2:] == piece[2:] and merged[-1][1] + 1 == piece[0]:
            merged[-1] = (merged[-1][0], *piece[1:])
        else:
            merged.append(piece)
    return merged


def _join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Summaries of all blocks to the start that is open when each begins, and how many windows came before."""
    out, start, opened = [], 0, 0
    for block, g in pdf.sort_values(["block", "lo"]).groupby("block"):
        out.append((block, start, opened))
        hit = int(np.searchsorted(g["lo"].to_numpy(), start, side="right")) - 1 if opened else 0
        if hit >= 0 and (not opened or start <= g["hi"].iloc[hit]):
            start, opened = int(g["exit"].iloc[hit]), opened + int(g["opened"].iloc[hit])
    return pd.DataFrame(out, columns=["block", "entry", "opened"]).astype("int64")


def _chain(rows: DataFrame, width: int, absolute: bool) -> tuple[DataFrame, DataFrame]:
    """``rows`` (block, seq, t) to the starts (block, seq, window_id, start, before) and the blocks (block, entry, opened).

    ``entry`` is the start that is open when the block begins, if any window was ``opened`` before. Rows follow each other by block, then ``seq``, then ``t``. ``before`` is the start of the window before.
    """
    ends = rows.groupBy("block").agg(F.max(F.struct("seq", "t")).alias("end"))
    prior = ends.select("block", F.lag("end.t").over(Window.orderBy("block")).alias("prior"))  # one row per block

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "t"])
        got = _pieces(pdf["t"].to_numpy(np.int64), None if pdf["first"].iloc[0] else int(pdf["prior"].iloc[0]), width, absolute)
        # A block that closes nothing is listed with an empty range.
        out = pd.DataFrame(got or [(0, -np.iinfo(np.int64).max, 0, 0)], columns=["lo", "hi", "exit", "opened"])
        return out.assign(block=pdf["block"].iloc[0])[["block", "lo", "hi", "exit", "opened"]]

    def listing(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "t"])
        t, i, out = pdf["t"].to_numpy(np.int64), 0, []
        start = int(pdf["entry"].iloc[0]) if pdf["opened"].iloc[0] else None
        while i < len(t):
            if start is not None:
                step = 1024
                while i < len(t):
                    hit = _closes(t[i : i + step], start, width, absolute)
                    if hit.any():
                        i += int(hit.argmax())
                        break
                    i, step = i + step, step * 2
                if i >= len(t):
                    break
            out.append((i, int(t[i]), start))
            start, i = int(t[i]), i + 1
        at = [i for i, _, _ in out]
        got = pd.DataFrame({"block": pdf["block"].iloc[0], "seq": pdf["seq"].to_numpy()[at], "window_id": int(pdf["opened"].iloc[0]) + np.arange(len(at)), "start": t[at]})
        return got.assign(before=pd.array([b for _, _, b in out], "Int64"))

    # No null reaches pandas, which would turn whole numbers into floating ones.
    told = rows.join(prior, "block").select("block", "seq", "t", F.coalesce("prior", F.lit(0)).cast("long").alias("prior"), F.col("prior").isNull().alias("first"))
    pieces = told.groupBy("block").applyInPandas(summary, "block long, lo long, hi long, exit long, opened long")
    blocks = pieces.groupBy().applyInPandas(_join_blocks, "block long, entry long, opened long")
    starts = rows.join(blocks, "block").groupBy("block").applyInPandas(listing, "block long, seq long, window_id long, start long, before long")
    return starts, blocks


def _cell(c: str, width: int) -> Column:
    return F.expr(f"(`{c}` - pmod(`{c}`, {width}L)) div {width}L")


def window_starts(ticks: DataFrame, width: int) -> DataFrame:
    """``ticks`` (t: long) to (window_id, start): the anchored windows of events in time order."""
    return _time_line(ticks, width)[0].select("window_id", "start")


def _time_line(ticks: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    rows = ticks.where("t IS NOT NULL").distinct().select(_cell("t", width * CELLS).alias("block"), F.col("t").alias("seq"), "t")
    return _chain(rows, width, False)


def anchored(events: DataFrame, time: Column, width: int, tick: str = "t") -> DataFrame:
    """``events`` with window_id and window_start; ``time`` is a whole number (seconds or raw ticks).

    Starts lie at least ``width`` apart, so a time cell of that width holds one at most: each cell knows the last start
    up to its end and the one before that, and every event finds its window by one equi-join on its cell.
    """
    e = events.withColumn(tick, time.cast("long"))
    starts, blocks = _time_line(e.select(F.col(tick).alias("t")), width)
    cells = e.select(_cell(tick, width).alias("c_")).where("c_ IS NOT NULL").distinct()
    none = F.lit(None).cast("long")
    line = cells.select("c_", _cell("c_", CELLS).alias("block"), F.expr(f"c_ * {width}L + {width - 1}L").alias("at"), none.alias("w"), none.alias("s"), none.alias("ps"))
    line = line.unionByName(starts.select(none.alias("c_"), "block", F.col("start").alias("at"), F.col("window_id").alias("w"), F.col("start").alias("s"), F.col("before").alias("ps")))
    entry = blocks.where("opened > 0").select(none.alias("c_"), "block", none.alias("at"), (F.col("opened") - 1).alias("w"), F.col("entry").alias("s"), none.alias("ps"))
    # A block's entry lies before all its cells, so the start before it is never asked for.
    over = Window.partitionBy("block").orderBy(F.col("at").asc_nulls_first(), F.col("c_").asc_nulls_first())
    mark = F.last(F.when(F.col("w").isNotNull(), F.struct("w", "s", "ps")), True).over(over)
    look = line.unionByName(entry).withColumn("m_", mark).where("c_ IS NOT NULL").select("c_", "m_")
    late = F.col(tick) >= F.col("m_.s")
    out = e.withColumn("c_", _cell(tick, width)).join(look, "c_")
    return out.select(*e.columns, F.when(late, F.col("m_.w")).otherwise(F.col("m_.w") - 1).alias("window_id"), F.when(late, F.col("m_.s")).otherwise(F.col("m_.ps")).alias("window_start"))


def anchored_arrivals(events: DataFrame, time: Column, seq: Column, width: int, absolute: bool = False) -> DataFrame:
    """``events`` with window_id and window_start in order of arrival, which ``seq`` (a whole number) numbers.

    A late event stays in the open window; with ``absolute`` one that is ``width`` or more before the start closes it
    as well. Equal numbers follow each other by time. Blocks are ranges of ``seq``, so it should be about gapless.
    """
    names = events.columns
    e = events.withColumns({"t_": time.cast("long"), "q_": seq.cast("long")}).where("t_ IS NOT NULL AND q_ IS NOT NULL").withColumn("b_", _cell("q_", ARRIVALS))
    starts, blocks = _chain(e.select(F.col("b_").alias("block"), F.col("q_").alias("seq"), F.col("t_").alias("t")), width, absolute)
    marks = starts.select(F.col("block").alias("b_"), F.col("seq").alias("q_"), F.col("start").alias("t_"), F.struct(F.col("window_id").alias("w"), F.col("start").alias("s")).alias("m_"))
    marks = marks.unionByName(blocks.where("opened > 0").select(F.col("block").alias("b_"), F.lit(None).cast("long").alias("q_"), F.lit(None).cast("long").alias("t_"), F.struct((F.col("opened") - 1).alias("w"), F.col("entry").alias("s")).alias("m_")))
    rows = e.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("e_"), "b_", "q_", "t_").unionByName(marks, allowMissingColumns=True)
    over = Window.partitionBy("b_").orderBy(F.col("q_").asc_nulls_first(), F.col("t_").asc_nulls_first(), F.col("m_").isNull())
    got = rows.withColumn("m_", F.last("m_", True).over(over)).where("e_ IS NOT NULL")
    return got.select("e_.*", F.col("m_.w").alias("window_id"), F.col("m_.s").alias("window_start"))


def sliding_load(events: DataFrame, time: str, key: str, task: str, size: str = "30 minutes", slide: str = "10 minutes") -> DataFrame:
    """Per sliding window and task: tuples, bytes of keys and distinct keys."""
    text = F.col(key).cast("string")
    return events.groupBy(F.window(time, size, slide).alias("w"), task).agg(
        F.count("*").alias("tuples"), F.sum(F.octet_length(text)).alias("bytes"), F.count_distinct(text).alias("keys")
    ).select(F.col("w.start").alias("window_start"), task, "tuples", "bytes", "keys")
