"""Load imbalance of an assignment of tuples to tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .partitioners import assign


def task_loads(df: DataFrame, n: int, key: str, *scope: str) -> DataFrame:
    """(scope, task, tuples, keys) of all ``n`` tasks, also those without tuples: scopes times tasks rows, as intended."""
    got = df.groupBy(*scope, "task").agg(F.count("*").alias("tuples"), F.count_distinct(key).alias("keys"))
    tasks = df.sparkSession.range(n).select(F.col("id").cast("int").alias("task"))
    grid = df.select(*scope).distinct().join(tasks) if scope else tasks
    zero = {"tuples": 0, "keys": 0}
    return grid.join(got, [*scope, "task"], "left").fillna(zero)


def imbalance(loads: DataFrame, *scope: str) -> DataFrame:
    """Largest less mean load, in tuples and in keys, with the extremes."""
    out = []
    for c in ("tuples", "keys"):
        out += [F.round(F.max(c) - F.avg(c), 4).alias(f"{c}_imbalance"), F.max(c).alias(f"max_{c}"), F.min(c).alias(f"min_{c}")]
    return loads.groupBy(*scope).agg(*out)


def strategy_table(df: DataFrame, names: tuple[str, ...], tasks: tuple[int, ...], key: str, seq: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row per strategy and number of tasks: ``imbalance`` over all scopes together, and the keys on several tasks."""
    rows = []
    for name in names:
        for n in tasks:
            placed = assign(df, name, n, key, seq, scope).select(key, "task")
            split = replicated(placed, key).agg(F.count("*").alias("split_keys"))
            line = imbalance(task_loads(placed, n, key)).join(F.broadcast(split))  # one row each
            rows.append(line.select(F.lit(name).alias("strategy"), F.lit(n).alias("n"), *line.columns))
    return reduce(DataFrame.unionByName, rows)


def replicated(df: DataFrame, key: str) -> DataFrame:
    """Keys on more than one task: (key, tasks)."""
    return df.groupBy(key).agg(F.count_distinct("task").alias("tasks")).where("tasks > 1")
