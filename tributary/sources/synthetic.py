"""Seeded synthetic streams of non-negative whole numbers, and their histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(spark: SparkSession, rows: int, most: int, seed: int = 0) -> DataFrame:
    return spark.range(rows).select("id", F.floor(F.rand(seed) * (most + 1)).cast("long").alias("v"))


def normal(spark: SparkSession, rows: int, most: int, seed: int = 0) -> DataFrame:
    """Mean ``most`` / 2, deviation a hundredth of that, cut at 0."""
    mean = most / 2
    return spark.range(rows).select("id", F.greatest(F.lit(0), F.round(F.randn(seed) * (mean / 100) + mean)).cast("long").alias("v"))


def lognormal(spark: SparkSession, rows: int, mean: float = 3.0, deviation: float = 0.5, seed: int = 0) -> DataFrame:
    return spark.range(rows).select("id", F.round(F.exp(F.randn(seed) * deviation + mean)).cast("long").alias("v"))


def histogram(df: DataFrame, column: str = "v", per_star: int = 200) -> DataFrame:
    """Count of each value, with a bar of one star per ``per_star`` rows."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("bar", F.repeat(F.lit("*"), F.floor(F.col("n") / per_star).cast("int")))
