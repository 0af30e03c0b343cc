"""Schemas of the delimited and columnar tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


def tpch(name: str) -> T.StructType:
    """Schema of a pipe-delimited TPC-H table; dates are dates, money is double, keys are long."""
    return _schema(TPCH[name])


TPCH = {
    "region": "r_regionkey long, r_name string, r_comment string",
    "nation": "n_nationkey long, n_name string, n_regionkey long, n_comment string",
    "part": "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "supplier": "s_suppkey long, s_name string, s_address string, s_nationkey long, s_phone string, s_acctbal double, s_comment string",
    "partsupp": "ps_partkey long, ps_suppkey long, ps_availqty int, ps_supplycost double, ps_comment string",
    "customer": "c_custkey long, c_name string, c_address string, c_nationkey long, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string"
    ),
}

TAXI_RAW = (
    "medallion string, hack_license string, pickup_datetime string, dropoff_datetime string, trip_time_in_secs string, trip_distance string, "
    "pickup_longitude string, pickup_latitude string, dropoff_longitude string, dropoff_latitude string, payment_type string, "
    "fare_amount string, surcharge string, mta_tax string, tip_amount string, tolls_amount string, total_amount string"
)
TAXI_COMPACT = (
    "medallion string, dropoff_datetime timestamp, trip_time_in_secs int, pickup_x int, pickup_y int, dropoff_x int, dropoff_y int, fare_amount double, tip_amount double"
)
CLUSTER = (
    "timestamp string, missing_info string, job_id string, task_index string, machine_id string, event_type string, user_name string, "
    "scheduling_class string, priority string, cpu_request string, ram_request string, disk_request string, constraints string"
)
