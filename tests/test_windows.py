"""Anchored windows against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import windows


def fold(rows, width, absolute):
    """(seq, t) rows in order of arrival to {seq: (window_id, start)}."""
    out, start, w = {}, None, -1
    for seq, t in sorted(rows):
        if start is None or (abs(t - start) if absolute else t - start) >= width:
            start, w = t, w + 1
        out[seq] = (w, start)
    return out


def stream(kind, n=700, seed=4):
    rnd, t, rows = random.Random(seed), -300, []
    for i in range(n):
        t += rnd.choice((0, 1, 2, 9)) if kind != "gaps" else rnd.choice((1, 2, 500))
        back = rnd.choice((0, 0, 3, 60, 200)) if kind == "late" else 0
        rows.append((i, rnd.randint(0, 400) if kind == "random" else t - back))
    return rows


@pytest.mark.parametrize("absolute", [False, True])
@pytest.mark.parametrize("kind", ["ordered", "late", "random", "gaps"])
def test_arrivals_equal_the_fold(spark, monkeypatch, kind, absolute):
    monkeypatch.setattr(windows, "ARRIVALS", 50)
    rows = stream(kind)
    df = spark.createDataFrame(rows, "seq long, t long")
    got = {r.seq: (r.window_id, r.window_start) for r in windows.anchored_arrivals(df, F.col("t"), F.col("seq"), 40, absolute).collect()}
    assert got == fold(rows, 40, absolute)


@pytest.mark.parametrize("kind", ["ordered", "gaps"])
def test_time_order_equals_the_fold(spark, monkeypatch, kind):
    monkeypatch.setattr(windows, "CELLS", 3)
    rows = stream(kind)
    df = spark.createDataFrame(rows, "seq long, t long")
    got = {r.seq: (r.window_id, r.window_start) for r in windows.anchored(df, F.col("t"), 40).collect()}
    assert got == fold(rows, 40, False)


def test_window_edges(spark):
    none = spark.createDataFrame([], "seq long, t long")
    assert windows.anchored(none, F.col("t"), 10).count() == 0
    assert windows.anchored_arrivals(none, F.col("t"), F.col("seq"), 10).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 5), (2, 5), (2, 30), (3, 4)], "seq long, t long")
    got = windows.anchored_arrivals(odd, F.col("t"), F.col("seq"), 10, True).collect()
    assert sorted((r.seq, r.t, r.window_id, r.window_start) for r in got) == [(2, 5, 0, 5), (2, 5, 0, 5), (2, 30, 1, 30), (3, 4, 2, 4)]


def test_long_ticks_stay_whole(spark):
    base = 1_700_000_000_000_000_001  # beyond what a double holds
    rows = [(i, base + 3 * i) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, t long")
    assert {r.seq: (r.window_id, r.window_start) for r in windows.anchored(df, F.col("t"), 7).collect()} == fold(rows, 7, False)
    assert {r.seq: (r.window_id, r.window_start) for r in windows.anchored_arrivals(df, F.col("t"), F.col("seq"), 7, True).collect()} == fold(rows, 7, True)
