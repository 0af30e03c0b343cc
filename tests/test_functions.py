import random

import pytest
from pyspark.sql import functions as F

from tributary.functions import bits, geo, stats
from tributary.functions.murmur import hash32, hash128, hash128_x86


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_murmur_vectors():
    assert hash32(b"", 0) == 0
    assert hash32(b"", 1) == 0x514E28B7
    assert hash32(b"test", 0) == 0xBA6BD213
    assert hash32(b"Hello, world!", 0x9747B28C) == 0x24884CBA
    assert hash128(b"", 0) == (0, 0)
    assert hash128(b"The quick brown fox jumps over the lazy dog", 0) == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)


def test_murmur_verification_values():
    """The published check of each form: the hash of the hashes of 256 keys."""
    forms = {
        0xB0F57EE3: lambda k, s: hash32(k, s).to_bytes(4, "little"),
        0xB3ECE62A: lambda k, s: b"".join(h.to_bytes(4, "little") for h in hash128_x86(k, s)),
        0x6384BA69: lambda k, s: b"".join(h.to_bytes(8, "little") for h in hash128(k, s)),
    }
    for want, form in forms.items():
        told = b"".join(form(bytes(range(i)), 256 - i) for i in range(256))
        assert int.from_bytes(form(told, 0)[:4], "little") == want


def test_grid_cells_hold_their_centres(spark):
    g = geo.grid(spark, 500.0, 40)
    x, y = geo.cell(F.col("lat"), F.col("lon"), 500.0, 40)
    assert g.count() == 1600 and g.where((x != F.col("x")) | (y != F.col("y"))).count() == 0
    corners = [F.col(f"{k}_{c}") for k in ("ne", "se", "sw", "nw") for c in ("lat", "lon")]
    assert g.where(~geo.inside(F.col("lat"), F.col("lon"), corners)).count() == 0


@pytest.mark.parametrize("x", [0, 1, 2, 3, 12, 255, 256, 2**31 - 1, 2**53 + 1, 2**62 + 7])
def test_bits(spark, x):
    c = F.lit(x).cast("long")
    low, high, zeros, rev, mid = one(spark, bits.lowest_bit(c), bits.highest_bit(c), bits.trailing_zeros(c), bits.reverse32(c), bits.isolate(c, 3, 5))
    assert low == x & -x
    assert high == (1 << x.bit_length() - 1 if x else 0)
    assert zeros == (((x & -x).bit_length() - 1) if x else 64)
    assert rev == int(f"{x & 0xFFFFFFFF:032b}"[::-1], 2)
    assert mid == x & (31 << 3)


def test_log2_of_power(spark):
    for k in range(0, 62, 7):
        assert one(spark, bits.log2_of_power(F.lit(1 << k).cast("long"))) == (k,)
    assert one(spark, bits.log2_of_power(F.lit(0).cast("long"))) == (0,)


def test_percentile(spark):
    a = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)])
    assert one(spark, *[stats.percentile(a, k) for k in (0.5, 0.3, 1.0, 1.5)]) == (3.5, 3.0, 4.0, -1.0)
    assert one(spark, stats.percentile(F.array().cast("array<double>"), 0.5)) == (-1.0,)
    assert stats.trimmed_mean([5, 1, 9, 4, 6]) == 5


def test_destination_and_distance_agree(spark):
    lat, lon = geo.destination(F.lit(41.0), F.lit(-74.0), F.lit(1234.5), F.lit(70.0))
    back = geo.distance(F.lit(41.0), F.lit(-74.0), lat, lon)
    assert abs(one(spark, back)[0] - 1234.5) < 1e-3


def test_cells_are_squares_of_their_side(spark):
    rnd = random.Random(1)
    for _ in range(5):
        i, j = rnd.randint(1, 299), rnd.randint(1, 299)
        lat, _ = geo.destination(F.lit(geo.GRID_LAT), F.lit(geo.GRID_LON), F.lit(500.0 * (j - 1)), F.lit(180.0))
        y = one(spark, geo.cell(lat, F.lit(geo.GRID_LON), 500.0, 300)[1])[0]
        assert y == j
    assert one(spark, *geo.cell(F.lit(10.0), F.lit(10.0), 500.0, 300)) == (None, None)


def test_percentiles_equal_the_array_form(spark):
    rnd = random.Random(2)
    rows = [(g, float(rnd.randint(0, 9))) for g in "abc" for _ in range({"a": 1, "b": 10, "c": 37}[g])]
    df = spark.createDataFrame(rows, "g string, v double")
    ks = {"x": 0.5, "y": 0.9, "z": 1.0, "w": 0.0, "bad": 2.0}
    arrays = df.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("a")).select("g", *[stats.percentile(F.col("a"), k).alias(n) for n, k in ks.items()])
    assert sorted(map(tuple, stats.percentiles(df, "g", "v", ks).collect())) == sorted(map(tuple, arrays.collect()))
