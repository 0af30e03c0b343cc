"""Order statistics as the measurements define them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(sorted_values: Column, k: float) -> Column:
    """k-quantile of a sorted array by position k*n: between two elements their mean, else the next one up.

    -1 for an empty array or a k outside 0..1; the last element where the position passes the end.
    """
    n = F.size(sorted_values)
    if not 0 <= k <= 1:
        return F.lit(-1.0)
    at = F.round(F.lit(k) * n, 9)
    up = F.least(F.ceil(at), n - 1).cast("int")
    whole = at == F.floor(at)
    second = F.least(at + 1, n - 1).cast("int")
    mean = (F.get(sorted_values, F.least(at, n - 1).cast("int")) + F.get(sorted_values, second)) / 2
    return F.when(n == 0, F.lit(-1.0)).when(whole, mean).otherwise(F.get(sorted_values, up)).cast("double")


def percentiles(df: DataFrame, group: str, value: str, ks: dict[str, float]) -> DataFrame:
    """``percentile`` per group without gathering a group: equal values are counted first, then ranked by a running sum.

    The window sorts one row per distinct value and spills; no array of a group's values is built.
    """
    w = Window.partitionBy(group)
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c_"))
    c = c.withColumns({"hi_": F.sum("c_").over(w.orderBy(value)), "n_": F.sum("c_").over(w)})
    at = lambda i: F.max(F.when((i < F.col("hi_")) & (i >= F.col("hi_") - F.col("c_")), F.col(value)))
    out = []
    for name, k in ks.items():
        if not 0 <= k <= 1:
            out.append(F.lit(-1.0).alias(name))
            continue
        pos, last = F.round(F.lit(k) * F.col("n_"), 9), F.col("n_") - 1
        whole = F.first(pos == F.floor(pos))
        first, second = at(F.least(F.floor(pos), last)), at(F.least(F.floor(pos) + 1, last))
        out.append(F.when(whole, (first + second) / 2).otherwise(at(F.least(F.ceil(pos), last))).cast("double").alias(name))
    return c.groupBy(group).agg(*out)


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def trimmed_mean(values: list[float]) -> float:
    """Mean without one largest and one smallest value, for repeated timings."""
    return sum(sorted(values)[1:-1]) / (len(values) - 2) if len(values) > 2 else sum(values) / max(1, len(values))
