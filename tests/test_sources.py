import pytest
from pyspark.errors import AnalysisException

from tributary.sources import readers, sinks, synthetic


def test_tbl(spark, tmp_path):
    (tmp_path / "lineitem.tbl").write_text("1|2|3|1|17|100.5|0.04|0.02|N|O|1996-03-13|1996-02-12|1996-03-22|DELIVER IN PERSON|TRUCK|a comment|\n")
    row = readers.tbl(spark, str(tmp_path / "lineitem.tbl"), "lineitem").first()
    assert (row.l_orderkey, row.l_extendedprice, str(row.l_shipdate), row.l_comment) == (1, 100.5, "1996-03-13", "a comment")


def test_taxi_round_trip(spark, tmp_path):
    good = "m1,h,2013-01-01 00:00:00,2013-01-01 00:05:00,300,1.2,-74.9,41.4,-74.8,41.3,CSH,6.5,0,0.5,1.5,0,8.5\n"
    (tmp_path / "raw.csv").write_text(good + good.replace("41.4", "not") + good.replace("41.3", "50.0"))
    rides = readers.taxi_raw(spark, str(tmp_path / "raw.csv"))
    assert rides.count() == 1
    sinks.compact_rides(rides, str(tmp_path / "compact"))
    back, first = readers.taxi_compact(spark, str(tmp_path / "compact")).first(), rides.first()
    assert (back.medallion, back.dropoff_datetime, back.pickup_x, back.dropoff_y, back.fare_amount, back.tip_amount) == ("m1", first.dropoff_datetime, first.pickup_x, first.dropoff_y, 6.5, 1.5)
    with pytest.raises(AnalysisException):
        sinks.compact_rides(rides, str(tmp_path / "compact"))


def test_cluster_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("5,,77,1,2,0,u,3,9,0.25,,,1\n6,,x,1,2,0,u,,9,,,,\n")
    (tmp_path / ".hidden.csv").write_text("1,,1,1,1,1,u,1,1,1,1,1,1\n")
    (tmp_path / "b.txt").write_text("1,,1,1,1,1,u,1,1,1,1,1,1\n")
    rows = sorted(readers.cluster_events(spark, str(tmp_path)).collect(), key=lambda r: r.timestamp)
    assert [(r.timestamp, r.job_id, r.scheduling_class, r.cpu_request, r.constraints) for r in rows] == [(5, 77, 3, 0.25, True), (6, 0, 0, 0.0, False)]


def test_synthetic(spark):
    for df in (synthetic.uniform(spark, 2000, 50), synthetic.normal(spark, 2000, 1000), synthetic.lognormal(spark, 2000)):
        assert df.where("v < 0").count() == 0 and df.count() == 2000
    h = synthetic.histogram(synthetic.uniform(spark, 2000, 3))
    assert sum(r.n for r in h.collect()) == 2000 and h.where("length(bar) <> floor(n / 200)").count() == 0
