"""Taxi queries over rides (medallion, dropoff_datetime, seq, pickup and dropoff cells, fare_amount, tip_amount)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tpch import top_with_ties


def route():
    """Column: the route as text, pickup and dropoff cell."""
    return F.format_string("%d.%d-%d.%d", "pickup_x", "pickup_y", "dropoff_x", "dropoff_y")


def cell(end: str):
    return F.format_string("%d.%d", f"{end}_x", f"{end}_y")


def frequent_routes(rides: DataFrame, k: int = 10, *scope: str) -> DataFrame:
    """Rides per route; rank at most ``k``. With ``scope`` columns, the counts of each scope."""
    n = rides.groupBy(*scope, route().alias("route")).agg(F.count("*").alias("count"))
    return n if scope else top_with_ties(n, k, F.desc("count"))


def last_dropoffs(rides: DataFrame, *scope: str) -> DataFrame:
    """Where each taxi was last seen: (medallion, cell); the later arrival wins on equal times."""
    return rides.groupBy(*scope, "medallion").agg(F.max_by(cell("dropoff"), F.struct("dropoff_datetime", "seq")).alias("cell"))


def median_fares(rides: DataFrame, *scope: str) -> DataFrame:
    """Exact median of fare and tip per pickup cell."""
    return rides.groupBy(*scope, cell("pickup").alias("cell")).agg(F.round(F.median(F.col("fare_amount") + F.col("tip_amount")), 4).alias("median_fare"))


def profitable_areas(rides: DataFrame, k: int = 10, outer: bool = True, *scope: str) -> DataFrame:
    """Median fare over empty taxis per cell; rank at most ``k``, or all cells of each scope.

    ``outer`` keeps cells that have empty taxis but no fares, with profit 0.
    """
    empty = last_dropoffs(rides, *scope).groupBy(*scope, "cell").agg(F.count("*").alias("empty_taxis"))
    both = empty.join(median_fares(rides, *scope), [*scope, "cell"], "left" if outer else "inner")
    fare = F.coalesce("median_fare", F.lit(0.0))
    out = both.where("empty_taxis > 0").select(*scope, "cell", fare.alias("median_fare"), "empty_taxis", F.round(fare / F.col("empty_taxis"), 4).alias("profit"))
    return out if scope else top_with_ties(out, k, F.desc("profit"))
