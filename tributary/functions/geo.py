"""Great-circle geometry and the square grid of the taxi queries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Earth radius in metres; centre of the grid's first cell.
EARTH_RADIUS = 6_371_000.0
GRID_LAT, GRID_LON = 41.474937, -74.913585


def destination(lat: Column, lon: Column, distance: Column, bearing: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of the point ``distance`` metres from a point along a bearing in degrees."""
    f, l, b, d = F.radians(lat), F.radians(lon), F.radians(bearing), distance / F.lit(EARTH_RADIUS)
    sine = F.sin(f) * F.cos(d) + F.cos(f) * F.sin(d) * F.cos(b)
    y, x = F.sin(b) * F.sin(d) * F.cos(f), F.cos(d) - F.sin(f) * sine
    return F.degrees(F.asin(sine)), F.degrees(l + F.atan2(y, x))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(h))


def square(lat: Column, lon: Column, side: float) -> list[Column]:
    """Corners of the square of ``side`` metres around a point: north-east, south-east, south-west, north-west."""
    out = []
    for bearing in (45.0, 135.0, 225.0, 315.0):
        out += destination(lat, lon, F.lit(side / 2**0.5), F.lit(bearing))
    return out


def cell(lat: Column, lon: Column, side: float, cells: int) -> tuple[Column, Column]:
    """One-based (east, south) cell of a point in a grid of ``cells`` by ``cells`` squares; null outside.

    Closed form: metres south and east of the first cell's centre, by arc lengths, over the side.
    """
    metre = 3.141592653589793 * EARTH_RADIUS / 180
    south = (F.lit(GRID_LAT) - lat) * F.lit(metre)
    east = (lon - F.lit(GRID_LON)) * F.lit(metre) * F.cos(F.radians(lat))
    n = lambda v: F.floor(v / F.lit(float(side)) + F.lit(1.5)).cast("int")
    keep = lambda v: F.when(v.between(1, cells), v)
    return keep(n(east)), keep(n(south))


def grid(spark: SparkSession, side: float, cells: int) -> DataFrame:
    """The grid as a table: (x, y), counted from one to the east and south, with centre and corners as of ``square``."""
    metre = 3.141592653589793 * EARTH_RADIUS / 180
    at = spark.range(cells * cells).select((F.col("id") % cells + 1).cast("int").alias("x"), F.expr(f"int(id div {cells} + 1)").alias("y"))
    at = at.withColumn("lat", F.lit(GRID_LAT) - (F.col("y") - 1) * F.lit(float(side) / metre))
    at = at.withColumn("lon", F.lit(GRID_LON) + (F.col("x") - 1) * F.lit(float(side) / metre) / F.cos(F.radians("lat")))
    names = [f"{corner}_{c}" for corner in ("ne", "se", "sw", "nw") for c in ("lat", "lon")]
    return at.select("*", *[c.alias(n) for n, c in zip(names, square(F.col("lat"), F.col("lon"), side))])


def inside(lat: Column, lon: Column, corners: list[Column]) -> Column:
    """Whether a point lies in a convex polygon of corners (lat, lon, lat, lon, ...) given clockwise."""
    k, test = len(corners) // 2, F.lit(True)
    for i in range(k):
        a_lat, a_lon = corners[2 * i], corners[2 * i + 1]
        b_lat, b_lon = corners[2 * ((i + 1) % k)], corners[2 * ((i + 1) % k) + 1]
        test = test & ((b_lon - a_lon) * (lat - a_lat) - (b_lat - a_lat) * (lon - a_lon) <= 0)
    return test
