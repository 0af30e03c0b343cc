"""Partition strategies: which of n tasks each tuple of an ordered stream goes to.

Round robin and field hashing are stateless and stay in the JVM. The others decide by the state that earlier
tuples left, so they are an ordered fold per stream. A stream is one scope (a source, a window): scopes fold
in parallel and independently, as several sources of a distributed stream do, and a single global fold is the
special case of one scope. Decisions by affinity depend on first sights only and can fold over distinct keys
(``first_sight``), which is how they scale with keys instead of tuples.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.murmur import folded
from .sketches import ExactCardinality, HipCardinality

#: Seeds of the candidate hashes, in order.
SEEDS = (313, 317, 331, 337, 347)

#: name: (choices, affinity, what decides, estimator)
STRATEGIES = {
    "pk": (2, False, "count", None),
    "m-pk": (5, False, "count", None),
    "cn": (2, False, "cardinality", ExactCardinality),
    "chll": (2, False, "cardinality", HipCardinality),
    "ln": (2, False, "load", ExactCardinality),
    "lhll": (2, False, "load", HipCardinality),
    "an": (2, True, "cardinality", ExactCardinality),
    "ahll": (2, True, "cardinality", HipCardinality),
    "can": (2, True, "count", ExactCardinality),
    "m-an": (5, True, "cardinality", ExactCardinality),
    "m-can": (5, True, "count", ExactCardinality),
}
NAMES = ("sh", "fld", *STRATEGIES)
#: Strategies that never split a key, so a merge of partial results could be skipped.
SINGLE_CHOICE = ("fld", "an", "can", "m-an", "m-can")


def single_choice(name: str) -> bool:
    return name in SINGLE_CHOICE


def key_bytes(key) -> bytes:
    return key.encode() if isinstance(key, str) else int(key).to_bytes(8, "little", signed=True)


class Fold:
    """State of one strategy over ``n`` tasks; ``next(key)`` gives the task and updates the state."""

    def __init__(self, name: str, n: int) -> None:
        self.choices, self.affinity, self.by, kind = STRATEGIES[name]
        self.n, self.counts = n, [0] * n
        self.sets = [kind() for _ in range(n)] if kind else None
        self.memo: dict = {}

    def candidates(self, key) -> tuple[int, list[int]]:
        got = self.memo.get(key)
        if got is None:
            h = [folded(key_bytes(key), s) for s in SEEDS[: self.choices]]
            got = self.memo[key] = (h[0], [x % self.n for x in h])
        return got

    def _cost(self, task: int) -> float:
        if self.by == "count":
            return self.counts[task]
        if self.by == "cardinality":
            return self.sets[task].count()
        cards = [s.count() for s in self.sets]
        spread = lambda v: max(v) - min(v) + 1
        return cards[task] / spread(cards) + self.counts[task] / spread(self.counts)

    def next(self, key) -> int:
        code, tasks = self.candidates(key)
        chosen = next((t for t in tasks if self.sets[t].what_if(code) == self.sets[t].count()), None) if self.affinity else None
        if chosen is None:
            if self.choices == 2:  # a tie goes to the second
                chosen = tasks[0] if self._cost(tasks[0]) < self._cost(tasks[1]) else tasks[1]
            else:
                chosen = min(tasks, key=self._cost)
        if self.sets:
            self.sets[chosen].insert(code)
        self.counts[chosen] += 1
        return chosen


def assign(df: DataFrame, name: str, n: int, key: str, seq: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its ``task`` under a strategy; ``seq`` orders the stream within each scope."""
    if name == "sh":
        return df.withColumn("task", F.pmod(F.row_number().over(Window.partitionBy(*scope).orderBy(seq)) - 1, F.lit(n)).cast("int"))
    if name == "fld":
        return df.withColumn("task", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(NAMES)}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq, kind="stable")
        fold = Fold(name, n)
        return pdf.assign(task=np.array([fold.next(k) for k in pdf[key]], np.int32))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*scope).applyInPandas(run, f"{fields}, task int")


def first_sight(df: DataFrame, name: str, n: int, key: str, seq: str) -> DataFrame:
    """``df`` with its task under an affinity strategy whose decisions depend on first sights only.

    The fold runs over one row per distinct key (its first ``seq``); tuples get their key's task by a join.
    """
    if name not in ("an", "m-an"):
        raise ValueError("only strategies that decide by distinct keys can fold over first sights")
    keys = df.groupBy(key).agg(F.min(seq).alias(seq))
    return df.join(assign(keys, name, n, key, seq).select(key, "task"), key)


def merged(partial: DataFrame, keys: list[str], merge: dict[str, Callable]) -> DataFrame:
    """Second phase of a two-phase aggregation: partial rows (task, keys, values) to one row per key."""
    return partial.groupBy(*keys).agg(*[f(c).alias(c) for c, f in merge.items()])


def placed(df: DataFrame, n: int) -> DataFrame:
    """Make ``task`` the physical partition of each row."""
    return df.repartitionById(n, F.col("task"))


def shed_first(df: DataFrame, seq: str) -> DataFrame:
    """Keep the first tuple of each task (what a shedder does that accepts while below the largest load)."""
    return df.groupBy("task").agg(F.min_by(F.struct(*[c for c in df.columns if c != "task"]), seq).alias("r")).select("r.*", "task")


def shed_above_mean(df: DataFrame, seq: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Drop a tuple if its task then holds more than the mean of tuples so far per task of the scope, rounded up."""
    tasks = df.select(*scope, "task").distinct().groupBy(*scope).agg(F.count("*").alias("n_")) if scope else df.agg(F.count_distinct("task").alias("n_"))
    w = Window.partitionBy(*scope).orderBy(seq)
    d = df.withColumns({"i_": F.row_number().over(w), "own_": F.row_number().over(Window.partitionBy(*scope, "task").orderBy(seq))})
    d = d.join(tasks, list(scope)) if scope else d.join(F.broadcast(tasks))
    return d.where(F.col("own_") <= F.ceil(F.col("i_") / F.col("n_"))).drop("i_", "own_", "n_")


def shed_heaviest(df: DataFrame, share: float = 0.5, seed: int = 1) -> DataFrame:
    """Drop a random ``share`` of the tuples of the task with most tuples."""
    heavy = df.groupBy("task").count().orderBy(F.desc("count"), "task").limit(1).select(F.col("task").alias("heavy_"))
    return df.join(F.broadcast(heavy)).where((F.col("task") != F.col("heavy_")) | (F.rand(seed) >= share)).drop("heavy_")


class WindowedFold:
    """Two choices by distinct keys per task over a sliding window of ``size``, kept in buckets of ``slide`` time units."""

    def __init__(self, n: int, size: int, slide: int) -> None:
        self.n, self.size, self.slide = n, size, slide
        self.buckets: dict[int, list[dict]] = {}
        self.live: list[dict] = [{} for _ in range(n)]

    def _evict(self, now: int) -> None:
        for b in [b for b in self.buckets if (b + 1) * self.slide <= now - self.size]:
            for task, seen in enumerate(self.buckets.pop(b)):
                for k, c in seen.items():
                    self.live[task][k] -= c
                    if not self.live[task][k]:
                        del self.live[task][k]

    def next(self, time: int, key) -> int:
        self._evict(time)
        a, b = (folded(key_bytes(key), s) % self.n for s in SEEDS[:2])
        chosen = a if len(self.live[a]) < len(self.live[b]) else b
        bucket = self.buckets.setdefault(time // self.slide, [{} for _ in range(self.n)])
        for seen in (bucket[chosen], self.live[chosen]):
            seen[key] = seen.get(key, 0) + 1
        return chosen


def assign_windowed(df: DataFrame, n: int, key: str, time: str, size: int, slide: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the ``task`` of the windowed strategy; ``time`` (long) orders the stream within each scope."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        fold = WindowedFold(n, size, slide)
        return pdf.assign(task=np.array([fold.next(int(t), k) for t, k in zip(pdf[time], pdf[key])], np.int32))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*scope).applyInPandas(run, f"{fields}, task int")


def assign_after(first: DataFrame, second: DataFrame, name: str, n: int, key: str, seq: str, scope: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Tasks of two inputs with the same columns under one state: ``second`` meets what ``first`` left.

    One fold over the tagged union in each scope; for a reset between inputs call ``assign`` twice.
    """
    both = first.withColumn("input_", F.lit(0)).unionByName(second.withColumn("input_", F.lit(1)))
    order = both.withColumn("order_", F.struct("input_", seq)).withColumn("order_", F.row_number().over(Window.partitionBy(*scope).orderBy("order_")))
    got = assign(order, name, n, key, "order_", scope)
    return tuple(got.where(F.col("input_") == i).drop("input_", "order_") for i in (0, 1))


@F.pandas_udf(T.IntegerType())
def murmur_task(key: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    """Task by the folded MurmurHash3 of the key, for ids that must equal those of another implementation."""
    memo: dict = {}
    return pd.Series([memo.setdefault((k, s), folded(key_bytes(k), s)) % m for k, m, s in zip(key, n, seed)], dtype="int32")


def latencies(df: DataFrame, name: str, n: int, key: str, seq: str, window: str, repeats: int = 5) -> DataFrame:
    """Per window how long assigning its tuples takes: (window, tuples, ms), the trimmed mean of repeats."""
    import time as clock

    from ..functions.stats import trimmed_mean

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, took = pdf.sort_values(seq)[key].tolist(), []
        for _ in range(repeats):
            fold, began = Fold(name, n), clock.perf_counter()
            for k in keys:
                fold.next(k)
            took.append((clock.perf_counter() - began) * 1e3)
        return pd.DataFrame({window: [pdf[window].iloc[0]], "tuples": [len(keys)], "ms": [trimmed_mean(took)]})

    return df.groupBy(window).applyInPandas(run, f"{window} {dict(df.dtypes)[window]}, tuples long, ms double")


def latency_report(measured: DataFrame, closed: bool = True) -> DataFrame:
    """``latencies`` to one row: windows, mean, median, p90 and p99 of ms. With ``closed`` the last window, which may be partial, is left out."""
    from ..functions.stats import percentiles

    window = measured.columns[0]
    if closed:
        last = measured.agg(F.max(window).alias("last_"))
        measured = measured.join(F.broadcast(last)).where(F.col(window) < F.col("last_")).drop("last_")  # one row
    one = measured.withColumn("all_", F.lit(1))
    ranks = percentiles(one, "all_", "ms", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return one.groupBy("all_").agg(F.count("*").alias("windows"), F.avg("ms").alias("mean")).join(ranks, "all_").drop("all_")
