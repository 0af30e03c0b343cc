"""TPC-H queries 1 and 3, their variants by calendar parts, and the joins they are built from.

Joins are declared as equi-joins without hints: the optimizer broadcasts a side by its estimated size and
re-plans at run time; beyond that both sides are shuffled on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import partitioners

Q1_DATE, Q3_DATE, SEGMENT = "1998-11-29", "1995-03-15", "BUILDING"


def top_with_ties(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Rows whose rank is at most ``k``: whole tie groups until k rows are reached.

    The limit is pushed below the exchange (a group limit per partition), so one task sees k rows and ties of
    each partition, not the table.
    """
    ranked = df.withColumn("rank_", F.rank().over(Window.orderBy(*order)))
    return ranked.where(F.col("rank_") <= k).drop("rank_")


def pricing_summary(lineitem: DataFrame, keep: Column) -> DataFrame:
    """Query 1: sums, means and count by return flag and line status."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    money = lambda c, name: F.round(c, 2).alias(name)
    return (
        lineitem.where(keep).groupBy("l_returnflag", "l_linestatus")
        .agg(
            money(F.sum("l_quantity"), "sum_qty"), money(F.sum("l_extendedprice"), "sum_base_price"), money(F.sum(price), "sum_disc_price"),
            money(F.sum(price * (1 + F.col("l_tax"))), "sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def pricing_summary_split(lineitem: DataFrame, keep: Column, strategy: str, n: int, scope: str) -> DataFrame:
    """Query 1 in two phases: partial sums on the ``n`` tasks of a strategy, folded per ``scope``, then their merge.

    Field hashing keeps a key on one task, so its partial sums are final and nothing is merged.
    """
    key, seq = F.concat("l_returnflag", "l_linestatus").alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = lineitem.where(keep).select(
        "l_returnflag", "l_linestatus", key, seq, scope, F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("base"), F.col("l_discount").alias("disc"),
        price.alias("disc_price"), (price * (1 + F.col("l_tax"))).alias("charge"),
    )
    keys, sums = ["l_returnflag", "l_linestatus"], ("qty", "base", "disc", "disc_price", "charge")
    part = partitioners.assign(rows, strategy, n, "key", "seq", (scope,)).groupBy("task", *keys).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("count_order"))
    if strategy != "fld":
        part = partitioners.merged(part, keys, {c: F.sum for c in (*sums, "count_order")})
    return part.select(
        *keys, *[F.round(c, 2).alias(f"sum_{name}") for c, name in (("qty", "qty"), ("base", "base_price"), ("disc_price", "disc_price"), ("charge", "charge"))],
        *[F.round(F.col(c) / F.col("count_order"), 4).alias(f"avg_{name}") for c, name in (("qty", "qty"), ("base", "price"), ("disc", "disc"))], "count_order",
    )


def q1_keep(compat: bool = False) -> Column:
    """The date filter; ``compat``: any day of 1998 or before."""
    return F.year("l_shipdate") <= 1998 if compat else F.col("l_shipdate") <= F.lit(Q1_DATE).cast("timestamp")


def semi_join_orders(customer: DataFrame, orders: DataFrame, keep: Column) -> DataFrame:
    """Orders of customers in the segment: (o_orderkey, o_orderdate, o_shippriority)."""
    buyers = customer.where(F.col("c_mktsegment") == SEGMENT).select("c_custkey")
    kept = orders.where(keep).join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    priority = F.col("o_shippriority") if "o_shippriority" in orders.columns else F.lit(0)
    return kept.select("o_orderkey", "o_orderdate", priority.alias("o_shippriority"))


def shipping_priority(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, compat: bool = False, k: int = 20) -> DataFrame:
    """Query 3: revenue per open order of a segment, the k highest with ties; ``compat`` compares days of the month."""
    if compat:
        early, late = F.dayofmonth("o_orderdate") < 15, F.dayofmonth("l_shipdate") > 15
    else:
        early, late = F.col("o_orderdate") < F.lit(Q3_DATE).cast("timestamp"), F.col("l_shipdate") > F.lit(Q3_DATE).cast("timestamp")
    first = semi_join_orders(customer, orders, early)
    joined = lineitem.where(late).join(first, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return top_with_ties(joined.groupBy("l_orderkey", "o_orderdate", "o_shippriority").agg(revenue), k, F.desc("revenue"))


def lineitem_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def customer_lineitem_orders(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    return lineitem_orders(lineitem, orders).join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
