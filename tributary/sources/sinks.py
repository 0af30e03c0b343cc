"""Delimited sinks and row serialisers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share, ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    home = sc.getConf().get("spark.checkpoint.dir")
    if not home and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{home or tempfile.mkdtemp(prefix='tributary-')}/{name}-{uuid.uuid4().hex}"


def tbl(df: DataFrame, path: str) -> None:
    """Write as a pipe-delimited table in the column order of its schema in ``schemas``; each row ends in a delimiter."""
    row_text(df, "|").select(F.concat("line", F.lit("|"))).write.text(path)


def csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write as CSV; an existing target is an error unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").csv(path)


def money(*cols: str, digits: int = 2) -> list[Column]:
    """Columns as text with fixed decimals, without grouping marks."""
    return [F.format_string(f"%.{digits}f", F.col(c)).alias(c) for c in cols]


def row_text(df: DataFrame, sep: str = ",") -> DataFrame:
    """Each row as one delimited line, nulls empty."""
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))


def compact_rides(rides: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rides in the nine-column compact form."""
    stamp = F.date_format("dropoff_datetime", "yyyy-MM-dd HH:mm:ss").alias("dropoff_datetime")
    csv(rides.select("medallion", stamp, "trip_time_in_secs", "pickup_x", "pickup_y", "dropoff_x", "dropoff_y", "fare_amount", "tip_amount"), path, overwrite)


def unpadded_date(c: Column) -> Column:
    """A date as year-month-day without leading zeros."""
    return F.date_format(c, "y-M-d")
