"""Scans: Parquet by default; pipe-delimited TPC-H files, taxi and cluster-trace CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from . import schemas


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tbl(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A ``|``-delimited TPC-H table. Rows may end in a delimiter. Unread columns are pruned by the scan."""
    return spark.read.schema(schemas.tpch(name)).option("sep", "|").option("dateFormat", "yyyy-MM-dd").csv(path)


def load_all(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(schemas.TPCH)) -> DataFrame:
    """(table, n): rows of each table of a folder of ``.tbl`` files."""
    counts = [tbl(spark, f"{folder}/{name}.tbl", name).agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name in names]
    return reduce(DataFrame.unionByName, counts)


def taxi_raw(spark: SparkSession, path: str, side: float = 500.0, cells: int = 300) -> DataFrame:
    """Raw taxi rides with pickup and dropoff cells; rides that start or end outside the grid are dropped."""
    raw = spark.read.schema(schemas.TAXI_RAW).csv(path)
    num = lambda c, t="double": F.col(c).try_cast(t)
    out = raw.select(
        "medallion", "hack_license",
        F.try_to_timestamp("pickup_datetime").alias("pickup_datetime"), F.try_to_timestamp("dropoff_datetime").alias("dropoff_datetime"),
        num("trip_time_in_secs", "int").alias("trip_time_in_secs"), num("trip_distance").alias("trip_distance"),
        *[num(c).alias(c) for c in ("pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude")],
        "payment_type", *[num(c).alias(c) for c in ("fare_amount", "surcharge", "mta_tax", "tip_amount", "tolls_amount", "total_amount")],
    )
    for end in ("pickup", "dropoff"):
        x, y = geo.cell(F.col(f"{end}_latitude"), F.col(f"{end}_longitude"), side, cells)
        out = out.withColumns({f"{end}_x": x, f"{end}_y": y})
    return out.where("pickup_x IS NOT NULL AND pickup_y IS NOT NULL AND dropoff_x IS NOT NULL AND dropoff_y IS NOT NULL")


def taxi_compact(spark: SparkSession, path: str) -> DataFrame:
    """Rides in the nine-column compact form that ``sinks.compact_rides`` writes."""
    return spark.read.schema(schemas.TAXI_COMPACT).csv(path)


def cluster_events(spark: SparkSession, folder: str) -> DataFrame:
    """Task events of every ``.csv`` file of a folder; empty or unreadable numbers are 0, as the traces define them."""
    raw = spark.read.schema(schemas.CLUSTER).option("pathGlobFilter", "*.csv").csv(folder)
    kinds = {"timestamp": "long", "missing_info": "int", "job_id": "long", "task_index": "long", "machine_id": "long", "event_type": "int", "scheduling_class": "int", "priority": "int", "cpu_request": "double", "ram_request": "double", "disk_request": "double"}
    cols = [F.coalesce(F.col(c).try_cast(kinds[c]), F.lit(0).cast(kinds[c])).alias(c) if c in kinds else F.col(c) for c in raw.columns if c != "constraints"]
    return raw.select(*cols, F.coalesce(F.col("constraints").try_cast("int") != 0, F.lit(False)).alias("constraints"))
