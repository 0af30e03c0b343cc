"""Cluster-monitoring queries over task events (timestamp, seq, scheduling_class, job_id, cpu_request)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tpch import top_with_ties


def total_cpu(events: DataFrame, k: int = 10, *scope: str) -> DataFrame:
    """Total CPU request per scheduling class with the first time seen; the ``k`` classes of largest whole total.

    With ``scope`` columns (a window's number) all classes of each scope are returned.
    """
    out = events.groupBy(*scope, "scheduling_class").agg(F.min_by("timestamp", "seq").alias("timestamp"), F.round(F.sum("cpu_request"), 2).alias("total_cpu"))
    return out if scope else out.orderBy(F.floor("total_cpu").desc(), "scheduling_class").limit(k)


def mean_cpu(events: DataFrame, k: int = 10, *scope: str) -> DataFrame:
    """Mean CPU request per job with the first time seen; rank at most ``k``. With ``scope``, all jobs of each scope."""
    out = events.groupBy(*scope, "job_id").agg(
        F.min_by("timestamp", "seq").alias("timestamp"), F.round(F.sum("cpu_request"), 2).alias("sum_cpu"), F.count("*").alias("count"), F.round(F.avg("cpu_request"), 4).alias("mean_cpu")
    )
    return out if scope else top_with_ties(out, k, F.desc("mean_cpu"))
