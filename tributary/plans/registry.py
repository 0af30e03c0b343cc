"""Registered queries and their oracle SQL (DuckDB), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, geo, stats
from ..operators import metrics, monitoring, partitioners, sketches, taxi, tpch, windows
from ..sources import readers, schemas, sinks
from ..sources.readers import parquet

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def cluster_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as task events."""
    e = parquet(spark, sf_dir, "events")
    return e.select(F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"), F.col("event_type").alias("scheduling_class"), F.col("user_id").alias("job_id"), F.col("value").alias("cpu_request"))


def taxi_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as rides, cells by fixed rules on the event's number."""
    at = lambda m: (1 + F.pmod(F.col("event_id") * m, F.lit(20))).cast("int")
    return parquet(spark, sf_dir, "events").select(
        F.col("user_id").alias("medallion"), F.col("ts").alias("dropoff_datetime"), F.col("event_id").alias("seq"), at(7).alias("pickup_x"), at(13).alias("pickup_y"),
        at(11).alias("dropoff_x"), at(17).alias("dropoff_y"), F.col("value").alias("fare_amount"), (F.col("value") * 0.1).alias("tip_amount"),
    )


TAXI = """rides AS (SELECT user_id AS medallion, ts, event_id AS seq, value + value * 0.1 AS paid,
  (1 + event_id * 7 % 20) || '.' || (1 + event_id * 13 % 20) AS pickup, (1 + event_id * 11 % 20) || '.' || (1 + event_id * 17 % 20) AS dropoff FROM events)"""


def _anchored_sql(seconds: int) -> str:
    """Anchored windows of ``events`` by jump pointers; ``marked`` has window_start (seconds) per event."""
    return f"""jumps AS (SELECT t, min(t) OVER (ORDER BY t RANGE BETWEEN {seconds} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
    FROM (SELECT DISTINCT CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)),
w AS (SELECT min(t) AS s FROM jumps UNION ALL SELECT j.nxt FROM w JOIN jumps j ON j.t = w.s WHERE j.nxt IS NOT NULL),
marked AS (SELECT e.*, w.s AS window_start FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) e ASOF JOIN w ON e.t >= w.s)"""


# TPC-H

_Q1 = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
 round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE {} GROUP BY 1, 2 ORDER BY 1, 2"""
_Q3 = """SELECT l_orderkey, o_orderdate, o_shippriority, revenue FROM (SELECT *, rank() OVER (ORDER BY revenue DESC) AS r FROM (
 SELECT l_orderkey, o_orderdate, 0 AS o_shippriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
 WHERE c_mktsegment = 'BUILDING' AND {} GROUP BY 1, 2)) WHERE r <= 20"""


@query(_Q1.format("l_shipdate <= TIMESTAMP '1998-11-29'"))
def tpch_q1(spark, d):
    return tpch.pricing_summary(parquet(spark, d, "lineitem"), tpch.q1_keep())


@query(_Q1.format("year(l_shipdate) <= 1998"))
def tpch_q1_compat(spark, d):
    return tpch.pricing_summary(parquet(spark, d, "lineitem"), tpch.q1_keep(compat=True))


@query(_Q3.format("o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'"))
def tpch_q3(spark, d):
    return tpch.shipping_priority(*[parquet(spark, d, t) for t in ("customer", "orders", "lineitem")])


@query(_Q3.format("day(o_orderdate) < 15 AND day(l_shipdate) > 15"))
def tpch_q3_compat(spark, d):
    return tpch.shipping_priority(*[parquet(spark, d, t) for t in ("customer", "orders", "lineitem")], compat=True)


def _q1_split(strategy: str):
    def run(spark, d):
        lines = parquet(spark, d, "lineitem").withColumn("source", F.pmod("l_orderkey", F.lit(16)))
        return tpch.pricing_summary_split(lines, tpch.q1_keep(), strategy, 8, "source")

    return run


for _name in ("sh", "fld", "pk", "cn", "an"):
    query(_Q1.format("l_shipdate <= TIMESTAMP '1998-11-29'"), f"tpch_q1_by_{_name}")(_q1_split(_name))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_lineitem_orders(spark, d):
    out = tpch.lineitem_orders(parquet(spark, d, "lineitem"), parquet(spark, d, "orders"))
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "o_custkey", "o_orderdate")


@query("SELECT c_mktsegment, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_customer_lineitem_orders(spark, d):
    out = tpch.customer_lineitem_orders(*[parquet(spark, d, t) for t in ("lineitem", "orders", "customer")])
    return out.groupBy("c_mktsegment").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT o_orderkey, o_orderdate, 0 AS o_shippriority FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-15' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q3_semi_join_orders(spark, d):
    return tpch.semi_join_orders(parquet(spark, d, "customer"), parquet(spark, d, "orders"), F.col("o_orderdate") < F.lit(tpch.Q3_DATE).cast("timestamp"))


# Cluster monitoring

@query("""SELECT * FROM (SELECT event_type AS scheduling_class, CAST(arg_min(ts, event_id) AS VARCHAR) AS timestamp, round(sum(value), 2) AS total_cpu
 FROM events GROUP BY 1) ORDER BY floor(total_cpu) DESC, scheduling_class LIMIT 10""")
def cluster_total_cpu(spark, d):
    return monitoring.total_cpu(cluster_view(spark, d)).withColumn("timestamp", F.col("timestamp").cast("string"))


@query("""SELECT job_id, timestamp, sum_cpu, "count", mean_cpu FROM (SELECT *, rank() OVER (ORDER BY mean_cpu DESC) AS r FROM (SELECT user_id AS job_id, CAST(arg_min(ts, event_id) AS VARCHAR) AS timestamp,
 round(sum(value), 2) AS sum_cpu, count(*) AS "count", round(avg(value), 4) AS mean_cpu FROM events GROUP BY 1)) WHERE r <= 10""")
def cluster_mean_cpu(spark, d):
    return monitoring.mean_cpu(cluster_view(spark, d)).withColumn("timestamp", F.col("timestamp").cast("string"))


# Taxi

@query(f"""WITH {TAXI}, n AS (SELECT pickup || '-' || dropoff AS route, count(*) AS "count" FROM rides GROUP BY 1)
 SELECT route, "count" FROM (SELECT *, rank() OVER (ORDER BY "count" DESC) AS r FROM n) WHERE r <= 10""")
def taxi_frequent_routes(spark, d):
    return taxi.frequent_routes(taxi_view(spark, d))


@query(f"WITH {TAXI} SELECT medallion, arg_max(dropoff, (ts, seq)) AS cell FROM rides GROUP BY 1")
def taxi_last_dropoff(spark, d):
    return taxi.last_dropoffs(taxi_view(spark, d))


@query(f"WITH {TAXI} SELECT pickup AS cell, round(median(paid), 4) AS median_fare FROM rides GROUP BY 1")
def taxi_median_fare(spark, d):
    return taxi.median_fares(taxi_view(spark, d))


_AREAS = f"""WITH {TAXI}, last AS (SELECT medallion, arg_max(dropoff, (ts, seq)) AS cell FROM rides GROUP BY 1),
 empty AS (SELECT cell, count(*) AS empty_taxis FROM last GROUP BY 1), fares AS (SELECT pickup AS cell, round(median(paid), 4) AS median_fare FROM rides GROUP BY 1),
 p AS (SELECT e.cell, COALESCE(f.median_fare, 0.0) AS median_fare, empty_taxis, round(COALESCE(f.median_fare, 0.0) / empty_taxis, 4) AS profit FROM empty e {{}} JOIN fares f ON e.cell = f.cell)
 SELECT cell, median_fare, empty_taxis, profit FROM (SELECT *, rank() OVER (ORDER BY profit DESC) AS r FROM p) WHERE r <= 10"""


@query(_AREAS.format("INNER"))
def taxi_profitable_areas_inner(spark, d):
    return taxi.profitable_areas(taxi_view(spark, d), outer=False)


@query(_AREAS.format("LEFT"))
def taxi_profitable_areas_outer(spark, d):
    return taxi.profitable_areas(taxi_view(spark, d))


# Windows

_SECONDS = F.unix_timestamp


@query(f"""WITH RECURSIVE {_anchored_sql(60000)} SELECT window_start, event_type AS scheduling_class, CAST(arg_min(ts, event_id) AS VARCHAR) AS timestamp, round(sum(value), 2) AS total_cpu FROM marked GROUP BY 1, 2""")
def window_anchored_cluster(spark, d):
    e = windows.anchored(cluster_view(spark, d), F.unix_timestamp("timestamp"), 60000)
    return monitoring.total_cpu(e, 10, "window_start").withColumn("timestamp", F.col("timestamp").cast("string"))


@query(f"""WITH RECURSIVE {_anchored_sql(43200)} SELECT window_start, user_id AS job_id, CAST(arg_min(ts, event_id) AS VARCHAR) AS timestamp, round(sum(value), 2) AS sum_cpu, count(*) AS "count", round(avg(value), 4) AS mean_cpu FROM marked GROUP BY 1, 2""")
def window_anchored_mean_cpu(spark, d):
    e = windows.anchored(cluster_view(spark, d), F.unix_timestamp("timestamp"), 43200)
    return monitoring.mean_cpu(e, 10, "window_start").withColumn("timestamp", F.col("timestamp").cast("string"))


@query(f"""WITH RECURSIVE {_anchored_sql(1800)} SELECT window_start, (1 + event_id * 7 % 20) || '.' || (1 + event_id * 13 % 20) || '-' || (1 + event_id * 11 % 20) || '.' || (1 + event_id * 17 % 20) AS route, count(*) AS "count" FROM marked GROUP BY 1, 2""")
def window_anchored_routes(spark, d):
    return taxi.frequent_routes(windows.anchored(taxi_view(spark, d), F.unix_timestamp("dropoff_datetime"), 1800), 10, "window_start")


@query(f"""WITH RECURSIVE {_anchored_sql(2700)},
 r AS (SELECT window_start, user_id AS medallion, ts, event_id AS seq, value + value * 0.1 AS paid, (1 + event_id * 7 % 20) || '.' || (1 + event_id * 13 % 20) AS pickup, (1 + event_id * 11 % 20) || '.' || (1 + event_id * 17 % 20) AS dropoff FROM marked),
 last AS (SELECT window_start, medallion, arg_max(dropoff, (ts, seq)) AS cell FROM r GROUP BY 1, 2), empty AS (SELECT window_start, cell, count(*) AS empty_taxis FROM last GROUP BY 1, 2),
 fares AS (SELECT window_start, pickup AS cell, round(median(paid), 4) AS median_fare FROM r GROUP BY 1, 2)
 SELECT e.window_start, e.cell, COALESCE(f.median_fare, 0.0) AS median_fare, empty_taxis, round(COALESCE(f.median_fare, 0.0) / empty_taxis, 4) AS profit
 FROM empty e LEFT JOIN fares f ON e.window_start = f.window_start AND e.cell = f.cell""")
def window_anchored_profit(spark, d):
    return taxi.profitable_areas(windows.anchored(taxi_view(spark, d), F.unix_timestamp("dropoff_datetime"), 2700), 10, True, "window_start")


def _late(events: DataFrame, time: str) -> DataFrame:
    """Every 23rd event arrives 100,000 seconds late, every 7th 3,000 seconds: ``t`` is when it happened."""
    seq = F.col("seq")
    late = F.when(seq % 23 == 0, 100_000).when(seq % 7 == 0, 3_000).otherwise(0)
    return events.withColumn("t", F.unix_timestamp(time) - late)


def _arrivals_sql(seconds: int, closes: str) -> str:
    """Anchored windows of ``events`` in order of arrival, one recursive step a window; ``marked`` has window_id and window_start."""
    return f"""late AS MATERIALIZED (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 23 = 0 THEN 100000 WHEN event_id % 7 = 0 THEN 3000 ELSE 0 END AS t FROM events),
w AS (SELECT CAST(0 AS BIGINT) AS window_id, min(event_id) AS first, arg_min(t, event_id) AS s FROM late
  UNION ALL SELECT window_id, event_id, t FROM (SELECT w.window_id + 1 AS window_id, l.event_id, l.t, row_number() OVER (ORDER BY l.event_id) AS r FROM w JOIN late l ON l.event_id > w.first AND {closes} >= {seconds}) WHERE r = 1),
marked AS (SELECT l.*, w.window_id, w.s AS window_start FROM late l ASOF JOIN w ON l.event_id >= w.first)"""


@query(f"""WITH RECURSIVE {_arrivals_sql(60000, 'abs(l.t - w.s)')} SELECT window_id, event_type AS scheduling_class, CAST(arg_min(ts, event_id) AS VARCHAR) AS timestamp, round(sum(value), 2) AS total_cpu FROM marked GROUP BY 1, 2""")
def window_absolute_cluster(spark, d):
    """Windows that an old enough event closes as well, over events that arrive late."""
    e = windows.anchored_arrivals(_late(cluster_view(spark, d), "timestamp"), F.col("t"), F.col("seq"), 60000, absolute=True)
    return monitoring.total_cpu(e, 10, "window_id").withColumn("timestamp", F.col("timestamp").cast("string"))


@query(f"""WITH RECURSIVE {_arrivals_sql(60000, 'abs(l.t - w.s)')} SELECT window_id, user_id AS job_id, CAST(arg_min(ts, event_id) AS VARCHAR) AS timestamp, round(sum(value), 2) AS sum_cpu, count(*) AS "count", round(avg(value), 4) AS mean_cpu FROM marked GROUP BY 1, 2""")
def window_absolute_mean_cpu(spark, d):
    e = windows.anchored_arrivals(_late(cluster_view(spark, d), "timestamp"), F.col("t"), F.col("seq"), 60000, absolute=True)
    return monitoring.mean_cpu(e, 10, "window_id").withColumn("timestamp", F.col("timestamp").cast("string"))


@query(f"WITH RECURSIVE {_arrivals_sql(1800, 'l.t - w.s')} SELECT event_id AS seq, window_id, window_start FROM marked")
def window_arrivals(spark, d):
    """The window of every event where late ones stay in the open window."""
    e = _late(taxi_view(spark, d), "dropoff_datetime")
    return windows.anchored_arrivals(e, F.col("t"), F.col("seq"), 1800).select("seq", "window_id", "window_start")


@query("""WITH s AS (SELECT *, CAST(user_id % 8 AS INTEGER) AS task, unnest(generate_series(0, 2)) AS k FROM events),
 p AS (SELECT task, user_id, (CAST(floor(epoch(ts) / 600) AS BIGINT) - k) * 600 AS window_start FROM s)
 SELECT window_start, task, count(*) AS tuples, CAST(sum(length(CAST(user_id AS VARCHAR))) AS BIGINT) AS bytes, count(DISTINCT user_id) AS keys FROM p GROUP BY 1, 2""")
def window_sliding_load(spark, d):
    e = parquet(spark, d, "events").withColumn("task", F.pmod("user_id", F.lit(8)).cast("int"))
    return windows.sliding_load(e, "ts", "user_id", "task").withColumn("window_start", F.unix_timestamp("window_start"))


# Partition strategies. Streams are eight sources that fold side by side.

def _sources(spark, d):
    return parquet(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.pmod("event_id", F.lit(8)).cast("int").alias("source"))


@query("SELECT source, task, count(*) AS n, sum(event_id) AS ids FROM (SELECT CAST(event_id % 8 AS INTEGER) AS source, event_id, CAST((row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) - 1) % 16 AS INTEGER) AS task FROM events) GROUP BY 1, 2")
def part_round_robin(spark, d):
    return partitioners.assign(_sources(spark, d), "sh", 16, "user_id", "event_id", ("source",)).groupBy("source", "task").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _invariants(df: DataFrame, n: int, most: int) -> DataFrame:
    """One row: tuples, keys, whether tasks are in range and no key of a source is on more than ``most`` tasks."""
    per = df.groupBy("source", "user_id").agg(F.count("*").alias("n"), F.count_distinct("task").alias("tasks"), F.min("task").alias("lo"), F.max("task").alias("hi"))
    return per.agg(F.sum("n").alias("tuples"), F.count("*").alias("keys"), (F.max("tasks") <= most).alias("within"), ((F.min("lo") >= 0) & (F.max("hi") < n)).alias("in_range"))


_INV = "SELECT CAST(sum(n) AS BIGINT) AS tuples, count(*) AS keys, true AS within, true AS in_range FROM (SELECT event_id % 8 AS s, user_id, count(*) AS n FROM events GROUP BY 1, 2)"


def _strategy(name: str, most: int):
    def run(spark, d):
        return _invariants(partitioners.assign(_sources(spark, d), name, 16, "user_id", "event_id", ("source",)), 16, most)

    return run


_MOST = {"fld": 1, "pk": 2, "m-pk": 5, "cn": 2, "chll": 2, "ln": 2, "lhll": 2, "an": 1, "ahll": 2, "can": 1, "m-an": 1, "m-can": 1}
for _name, _most in _MOST.items():
    query(_INV, f"part_{_name.replace('-', '_')}_invariants")(_strategy(_name, _most))


def _choice(name: str) -> str:
    """SQL for the task that a strategy picks, from lists ``c`` (candidates), ``counts``, ``seen`` (codes per task) and the tuple's ``code``."""
    choices, affinity, by, _ = partitioners.STRATEGIES[name]
    spread = lambda v: f"(list_max({v}) - list_min({v}) + 1)"
    cards = "list_transform(seen, lambda z: len(z))"
    cost = {
        "count": lambda t: f"CAST(counts[{t} + 1] AS DOUBLE)", "cardinality": lambda t: f"CAST(len(seen[{t} + 1]) AS DOUBLE)",
        "load": lambda t: f"(CAST(len(seen[{t} + 1]) AS DOUBLE) / {spread(cards)} + CAST(counts[{t} + 1] AS DOUBLE) / {spread('counts')})",
    }[by]
    if choices == 2:
        free = f"CASE WHEN {cost('c[1]')} < {cost('c[2]')} THEN c[1] ELSE c[2] END"
    else:  # the first of the least
        free = f"c[list_position(list_transform(c, lambda t: {cost('t')}), list_min(list_transform(c, lambda t: {cost('t')})))]"
    known = "list_filter(c, lambda t: list_contains(seen[t + 1], code))[1]"
    return f"COALESCE({known}, {free})" if affinity else free


def _fold_sql(name: str, n: int, per: int | None = None) -> str:
    """Oracle of ``name`` over ``supplier`` by nation: a recursive fold, anew in every ``per`` suppliers if that is given.

    The candidate tasks of the 25 nations are hash values and given as such; what is decided from them is computed here.
    """
    k = partitioners.STRATEGIES[name][0]
    hashes = {key: [partitioners.folded(partitioners.key_bytes(key), seed) for seed in partitioners.SEEDS[:k]] for key in range(25)}
    values = ", ".join(f"({key}, {key}::BIGINT, {[x % n for x in h]})" for key, h in hashes.items())
    scope, zero, none = f"s_suppkey // {per}" if per else "0", f"[{', '.join(['0'] * n)}]::BIGINT[]", f"[{', '.join(['[]::BIGINT[]'] * n)}]"
    return f"""WITH RECURSIVE cand(k, code, c) AS (VALUES {values}),
s AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, CAST({scope} AS BIGINT) AS w, s_suppkey, s_nationkey, code, c FROM supplier JOIN cand ON k = s_nationkey),
f AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS w, CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS BIGINT) AS s_nationkey, {zero} AS counts, {none} AS seen, CAST(NULL AS BIGINT) AS task
  UNION ALL
  SELECT i, w, s_suppkey, s_nationkey, list_transform(counts, lambda x, j: x + CASE WHEN j - 1 = t THEN 1 ELSE 0 END),
         list_transform(seen, lambda x, j: CASE WHEN j - 1 = t AND NOT list_contains(x, code) THEN list_append(x, code) ELSE x END), t
  FROM (SELECT *, CAST({_choice(name)} AS BIGINT) AS t
        FROM (SELECT s.i, s.w, s.s_suppkey, s.s_nationkey, s.code, s.c, CASE WHEN s.w = f.w THEN f.counts ELSE {zero} END AS counts, CASE WHEN s.w = f.w THEN f.seen ELSE {none} END AS seen
              FROM f JOIN s ON s.i = f.i + 1)))
SELECT w AS window_id, CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(task AS INTEGER) AS task FROM f WHERE i > 0"""


def _folded(name: str, n: int, per: int | None = None):
    def run(spark, d):
        window = F.floor(F.col("s_suppkey") / F.lit(per)) if per else F.lit(0)
        s = parquet(spark, d, "supplier").select(window.cast("long").alias("window_id"), F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_nationkey").cast("long").alias("s_nationkey"))
        return partitioners.assign(s, name, n, "s_nationkey", "s_suppkey", ("window_id",))

    return run


#: Strategies with exact counts: every tuple's task, over the whole stream and anew in every window.
for _name in ("pk", "m-pk", "cn", "ln", "an", "can", "m-an", "m-can"):
    query(_fold_sql(_name, 6), f"part_{_name.replace('-', '_')}_tasks")(_folded(_name, 6))
    query(_fold_sql(_name, 6, 20), f"window_{_name.replace('-', '_')}_tasks")(_folded(_name, 6, 20))


@query(f"SELECT window_id, CAST(max(n) - avg(n) AS DOUBLE) AS imbalance, max(n) AS most FROM (SELECT window_id, t.task, count(f.task) AS n FROM (SELECT DISTINCT window_id, unnest(range(6)) AS task FROM ({_fold_sql('cn', 6, 20)})) t LEFT JOIN ({_fold_sql('cn', 6, 20)}) f USING (window_id, task) GROUP BY 1, 2) GROUP BY 1")
def window_strategy_imbalance(spark, d):
    """Tuple imbalance of a strategy in every window: the largest task's tuples over the mean of all six."""
    per = _folded("cn", 6, 20)(spark, d).groupBy("window_id", "task").agg(F.count("*").alias("n"))
    return per.groupBy("window_id").agg((F.max("n") - F.sum("n") / F.lit(6)).alias("imbalance"), F.max("n").alias("most"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, task FROM supplier JOIN (VALUES " + ", ".join(f"({k}, CAST({partitioners.folded(partitioners.key_bytes(k), partitioners.SEEDS[0]) % 6} AS INTEGER))" for k in range(25)) + ") c(k, task) ON k = s_nationkey")
def part_field_tasks(spark, d):
    """Field hashing by the first candidate's hash."""
    task = partitioners.murmur_task(F.col("s_nationkey").cast("long"), F.lit(6), F.lit(partitioners.SEEDS[0]))
    return parquet(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), task.alias("task"))


_TABLE = [(name, n) for name in ("pk", "cn", "an") for n in (4, 6)]


@query(" UNION ALL ".join(
    f"""SELECT '{name}' AS strategy, {n} AS n, round(max(c) - avg(c), 4) AS tuples_imbalance, max(c) AS max_tuples, min(c) AS min_tuples, round(max(k) - avg(k), 4) AS keys_imbalance, max(k) AS max_keys, min(k) AS min_keys,
 (SELECT count(*) FROM (SELECT s_nationkey FROM ({_fold_sql(name, n)}) GROUP BY 1 HAVING count(DISTINCT task) > 1)) AS split_keys
 FROM (SELECT r.t, count(f.task) AS c, count(DISTINCT f.s_nationkey) AS k FROM range({n}) r(t) LEFT JOIN ({_fold_sql(name, n)}) f ON f.task = r.t GROUP BY 1)"""
    for name, n in _TABLE
))
def part_metrics_table(spark, d):
    """One row of load metrics per strategy and number of tasks."""
    s = parquet(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_nationkey").cast("long").alias("s_nationkey"))
    return metrics.strategy_table(s, ("pk", "cn", "an"), (4, 6), "s_nationkey", "s_suppkey")


@query(f"WITH t AS ({_fold_sql('an', 6)}) SELECT s_suppkey, s_nationkey, task FROM t")
def part_first_sight_tasks(spark, d):
    s = parquet(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_nationkey").cast("long").alias("s_nationkey"))
    return partitioners.first_sight(s, "an", 6, "s_nationkey", "s_suppkey").select("s_suppkey", "s_nationkey", "task")


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def part_two_phase_agg(spark, d):
    """Partial sums per task of a key-splitting strategy, then the merge: equal to the plain aggregate."""
    t = partitioners.assign(_sources(spark, d), "pk", 16, "user_id", "event_id", ("source",))
    partial = t.groupBy("task", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return partitioners.merged(partial, ["user_id"], {"n": F.sum, "total": lambda c: F.round(F.sum(c), 2)})


@query("SELECT count(*) AS tuples, count(DISTINCT user_id) AS keys, true AS affine FROM events")
def part_first_sight(spark, d):
    t = partitioners.first_sight(_sources(spark, d), "an", 16, "user_id", "event_id")
    per = t.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("task").alias("tasks"))
    return per.agg(F.sum("n").alias("tuples"), F.count("*").alias("keys"), (F.max("tasks") == 1).alias("affine"))


@query("SELECT CAST(user_id % 16 AS INTEGER) AS task, min(event_id) AS event_id FROM events GROUP BY 1")
def part_shed_first(spark, d):
    e = parquet(spark, d, "events").select("event_id", F.pmod("user_id", F.lit(16)).cast("int").alias("task"))
    return partitioners.shed_first(e, "event_id").select("task", "event_id")


@query("""WITH e AS (SELECT event_id % 8 AS source, user_id % 16 AS task, event_id FROM events), n AS (SELECT source, count(DISTINCT task) AS n FROM e GROUP BY 1),
 r AS (SELECT e.source, n.n, row_number() OVER (PARTITION BY e.source ORDER BY event_id) AS i, row_number() OVER (PARTITION BY e.source, task ORDER BY event_id) AS own FROM e JOIN n ON e.source = n.source)
 SELECT CAST(source AS INTEGER) AS source, count(*) AS kept FROM r WHERE own <= ceil(i / CAST(n AS DOUBLE)) GROUP BY 1""")
def part_shed_mean(spark, d):
    e = _sources(spark, d).select("source", "event_id", F.pmod("user_id", F.lit(16)).cast("int").alias("task"))
    return partitioners.shed_above_mean(e, "event_id", ("source",)).groupBy("source").agg(F.count("*").alias("kept"))


@query()
def random_shed(spark, d):
    e = parquet(spark, d, "events").select("event_id", F.pmod("user_id", F.lit(16)).cast("int").alias("task"))
    return partitioners.shed_heaviest(e).groupBy("task").agg(F.count("*").alias("kept"))


@query("SELECT task, count(*) AS n FROM (SELECT CAST(user_id % 16 AS INTEGER) AS task FROM events) GROUP BY 1")
def part_placed(spark, d):
    """The task number as physical partition: no further exchange for the count per task."""
    e = parquet(spark, d, "events").select(F.pmod("user_id", F.lit(16)).cast("int").alias("task"))
    return partitioners.placed(e, 16).groupBy("task").agg(F.count("*").alias("n"))


# Imbalance

_LOADS = """WITH e AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, user_id % 16 AS task, user_id FROM events), g AS (SELECT day, t AS task FROM (SELECT DISTINCT day FROM e), range(16) r(t)),
 l AS (SELECT g.day, g.task, count(e.task) AS tuples, count(DISTINCT e.user_id) AS keys FROM g LEFT JOIN e ON g.day = e.day AND g.task = e.task GROUP BY 1, 2)
 SELECT day, round(max({c}) - avg({c}), 4) AS {c}_imbalance, max({c}) AS max_{c}, min({c}) AS min_{c} FROM l GROUP BY 1"""


def _daily(spark, d):
    e = parquet(spark, d, "events").select(F.floor(F.unix_timestamp("ts") / 86400).alias("day"), F.pmod("user_id", F.lit(16)).cast("int").alias("task"), "user_id")
    return metrics.imbalance(metrics.task_loads(e, 16, "user_id", "day"), "day")


@query(_LOADS.format(c="tuples"))
def imbalance_tuple(spark, d):
    return _daily(spark, d).select("day", "tuples_imbalance", "max_tuples", "min_tuples")


@query(_LOADS.format(c="keys"))
def imbalance_key(spark, d):
    return _daily(spark, d).select("day", "keys_imbalance", "max_keys", "min_keys")


@query("SELECT user_id, count(DISTINCT event_id % 16) AS tasks FROM events GROUP BY 1 HAVING tasks > 1")
def replicated_keys(spark, d):
    e = parquet(spark, d, "events").select("user_id", F.pmod("event_id", F.lit(16)).cast("int").alias("task"))
    return metrics.replicated(e, "user_id")


# Sketches

@query("SELECT event_type, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def distinct_exact(spark, d):
    return parquet(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("keys"))


_WITHIN = "SELECT event_type, count(DISTINCT user_id) AS keys, true AS within FROM events GROUP BY 1"


def _within(spark, d, estimate):
    e = parquet(spark, d, "events")
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("keys"))
    return exact.join(estimate(e, "event_type", "user_id"), "event_type").select("event_type", "keys", (F.abs(F.col("estimate") - F.col("keys")) <= F.col("keys") * 0.06 + 2).alias("within"))


@query(_WITHIN)
def distinct_hll_within_bound(spark, d):
    return _within(spark, d, sketches.hll_distinct)


@query(_WITHIN)
def distinct_hip_within_bound(spark, d):
    return _within(spark, d, sketches.hip_distinct)


@query("SELECT event_type, true AS grows FROM events GROUP BY 1")
def distinct_what_if(spark, d):
    """HLL estimates as if one unseen value were added: never smaller, about one more."""
    e = parquet(spark, d, "events").groupBy("event_type").agg(F.hll_sketch_agg("user_id", F.lit(12)).alias("s"), F.hll_sketch_agg(F.lit(-1).cast("long"), F.lit(12)).alias("one"))
    out = sketches.hll_what_if(e.withColumn("now", F.hll_sketch_estimate("s")), F.col("s"), F.col("one"))
    return out.select("event_type", (F.col("what_if") - F.col("now")).between(0, 2).alias("grows"))


# Sources and sinks: each query writes a file form of a table and returns what its scan reads back.

def _as_tbl(spark, d, name: str) -> DataFrame:
    """A table in the columns of its file form; columns that the Parquet table lacks are null."""
    have, t = parquet(spark, d, name), schemas.tpch(name)
    return have.select(*[(F.col(f.name) if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.fields])


_TBL = {
    "region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey", "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal", "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
}


def _scan_tbl(name: str):
    dates = {"orders": "o_orderdate", "lineitem": "l_shipdate"}.get(name)

    def run(spark, d):
        path = sinks.scratch(spark, name)
        sinks.tbl(_as_tbl(spark, d, name), path)
        out = readers.tbl(spark, path, name)
        return out.select(*[F.col(c).cast("string").alias(c) if c == dates else F.col(c) for c in _TBL[name].split(", ")])

    columns = [f"strftime({c}, '%Y-%m-%d') AS {c}" if c == dates else f"CAST({c} AS BIGINT) AS {c}" if c.endswith("key") else c for c in _TBL[name].split(", ")]
    query(f"SELECT {', '.join(columns)} FROM {name}", f"scan_tbl_{name}")(run)


for _name in _TBL:
    _scan_tbl(_name)


@query(" UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS n FROM {name}" for name in _TBL))
def scan_load_all(spark, d):
    folder = sinks.scratch(spark, "tables")
    for name in _TBL:
        sinks.tbl(_as_tbl(spark, d, name), f"{folder}/{name}.tbl")
    return readers.load_all(spark, folder, tuple(_TBL))


def _raw_rides(spark, d) -> DataFrame:
    """``events`` as raw rides: every 50th without a readable latitude, some beyond the grid."""
    at = lambda m, step: F.pmod(F.col("event_id") * m, F.lit(1000)) * step
    lat = F.when(F.col("event_id") % 50 == 0, F.lit("n/a")).otherwise((F.lit(41.474937) - at(3, 0.0011)).cast("string"))
    off, stamp = F.expr("timestampadd(SECOND, 600, ts)"), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    fare = F.round("value", 2)
    cols = {
        "medallion": F.col("user_id"), "hack_license": F.lit("h"), "pickup_datetime": stamp("ts"), "dropoff_datetime": stamp(off), "trip_time_in_secs": F.lit(600), "trip_distance": F.lit(1.5),
        "pickup_longitude": F.lit(-74.913585) + at(7, 0.0013), "pickup_latitude": lat, "dropoff_longitude": F.lit(-74.913585) + at(11, 0.0013), "dropoff_latitude": F.lit(41.474937) - at(13, 0.0011),
        "payment_type": F.lit("CSH"), "fare_amount": fare, "surcharge": F.lit(0), "mta_tax": F.lit(0.5), "tip_amount": F.lit(1.25), "tolls_amount": F.lit(0), "total_amount": F.round(fare + 1.75, 2),
    }
    return parquet(spark, d, "events").select(*[c.cast("string").alias(n) for n, c in cols.items()])


def _cell_sql(lat: str, lon: str) -> tuple[str, str]:
    metre = "CAST(111194.92664455873 AS DOUBLE)"
    return f"CAST(floor(({lon} - (-74.913585)) * {metre} * cos(radians({lat})) / 500.0 + 1.5) AS INTEGER)", f"CAST(floor((41.474937 - {lat}) * {metre} / 500.0 + 1.5) AS INTEGER)"


_RIDES = f"""SELECT CAST(user_id AS VARCHAR) AS medallion, strftime(ts + INTERVAL 600 SECOND, '%Y-%m-%d %H:%M:%S') AS dropoff, 600 AS trip_time_in_secs, {_cell_sql('plat', 'plon')[0]} AS pickup_x, {_cell_sql('plat', 'plon')[1]} AS pickup_y,
 {_cell_sql('dlat', 'dlon')[0]} AS dropoff_x, {_cell_sql('dlat', 'dlon')[1]} AS dropoff_y, round(value, 2) AS fare_amount, CAST(1.25 AS DOUBLE) AS tip_amount
 FROM (SELECT *, 41.474937 - (event_id * 3 % 1000) * CAST(0.0011 AS DOUBLE) AS plat, -74.913585 + (event_id * 7 % 1000) * CAST(0.0013 AS DOUBLE) AS plon, 41.474937 - (event_id * 13 % 1000) * CAST(0.0011 AS DOUBLE) AS dlat, -74.913585 + (event_id * 11 % 1000) * CAST(0.0013 AS DOUBLE) AS dlon
  FROM events WHERE event_id % 50 <> 0)"""
_RIDES = f"SELECT * FROM ({_RIDES}) WHERE greatest(pickup_x, pickup_y, dropoff_x, dropoff_y) <= 300 AND least(pickup_x, pickup_y, dropoff_x, dropoff_y) >= 1"
_RIDE = ("medallion", "dropoff", "trip_time_in_secs", "pickup_x", "pickup_y", "dropoff_x", "dropoff_y", "fare_amount", "tip_amount")


def _ride_rows(rides: DataFrame) -> DataFrame:
    return rides.withColumn("dropoff", F.date_format("dropoff_datetime", "yyyy-MM-dd HH:mm:ss")).select(*_RIDE)


@query(_RIDES)
def scan_taxi_raw(spark, d):
    path = sinks.scratch(spark, "rides")
    sinks.csv(_raw_rides(spark, d), path)
    return _ride_rows(readers.taxi_raw(spark, path))


@query(_RIDES)
def scan_taxi_compact(spark, d):
    """Raw rides to the compact form and back."""
    raw, compact = sinks.scratch(spark, "rides"), sinks.scratch(spark, "compact")
    sinks.csv(_raw_rides(spark, d), raw)
    sinks.compact_rides(readers.taxi_raw(spark, raw), compact)
    return _ride_rows(readers.taxi_compact(spark, compact))


@query("""SELECT event_id AS timestamp, user_id AS job_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE CAST(event_id % 4 AS INTEGER) END AS scheduling_class, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE value END AS cpu_request, event_id % 2 = 1 AS constraints FROM events""")
def scan_cluster(spark, d):
    """Task events of a folder; empty and unreadable numbers are 0."""
    e, path = parquet(spark, d, "events"), sinks.scratch(spark, "cluster")
    i = F.col("event_id")
    rows = e.select(
        i, F.lit(None).cast("string").alias("missing"), "user_id", F.lit(1).alias("task"), F.lit(2).alias("machine"), F.lit(0).alias("kind"), F.lit("u").alias("name"), F.when(i % 9 != 0, (i % 4).cast("string")).alias("class"), F.lit(9).alias("priority"),
        F.when(i % 11 == 0, F.lit("x")).otherwise(F.col("value").cast("string")).alias("cpu"), F.lit(0.5).alias("ram"), F.lit(None).cast("string").alias("disk"), (i % 2).alias("constraints"),
    )
    sinks.csv(rows, path)
    return readers.cluster_events(spark, path).select("timestamp", "job_id", "scheduling_class", "cpu_request", "constraints")


# Functions

@query("""WITH v AS (SELECT event_type, list_sort(list(round(value, 2))) AS a, count(*) AS n FROM events GROUP BY 1)
 SELECT event_type, """ + ", ".join(
    f"round(CASE WHEN round({k} * n, 9) = floor(round({k} * n, 9)) THEN (a[CAST(least({k} * n, n - 1) AS BIGINT) + 1] + a[CAST(least({k} * n + 1, n - 1) AS BIGINT) + 1]) / 2 ELSE a[CAST(least(ceil({k} * n), n - 1) AS BIGINT) + 1] END, 4) AS {c}"
    for k, c in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))
) + " FROM v")
def percentile_ref(spark, d):
    v = parquet(spark, d, "events").select("event_type", F.round("value", 2).alias("v"))
    p = stats.percentiles(v, "event_type", "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return p.select("event_type", *[F.round(c, 4).alias(c) for c in ("p50", "p90", "p99")])


_POINT = "41.474937 - (event_id % 1000) * 0.0011 AS lat, -74.913585 + (event_id % 777) * 0.0013 AS lon"


def _points(spark, d):
    e = F.col("event_id")
    return parquet(spark, d, "events").select("event_id", (F.lit(41.474937) - F.pmod(e, F.lit(1000)) * 0.0011).alias("lat"), (F.lit(-74.913585) + F.pmod(e, F.lit(777)) * 0.0013).alias("lon"))


@query(f"""SELECT event_id, round(2 * 6371000.0 * asin(sqrt(pow(sin((radians(lat) - radians(41.474937)) / 2), 2) + cos(radians(41.474937)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(-74.913585)) / 2), 2))), 2) AS metres
 FROM (SELECT event_id, {_POINT} FROM events)""")
def geo_distance(spark, d):
    return _points(spark, d).select("event_id", F.round(geo.distance(F.lit(geo.GRID_LAT), F.lit(geo.GRID_LON), F.col("lat"), F.col("lon")), 2).alias("metres"))


@query(f"""SELECT event_id, round(degrees(asin(s)), 6) AS to_lat, round(degrees(radians(lon) + atan2(sin(radians(90.0)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * s)), 6) AS to_lon
 FROM (SELECT *, sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(90.0)) AS s FROM (SELECT event_id, {_POINT}, 500.0 / 6371000.0 AS d FROM events))""")
def geo_destination(spark, d):
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.lit(500.0), F.lit(90.0))
    return _points(spark, d).select("event_id", F.round(lat, 6).alias("to_lat"), F.round(lon, 6).alias("to_lon"))


@query(f"""SELECT event_id, CASE WHEN x BETWEEN 1 AND 300 THEN x END AS x, CASE WHEN y BETWEEN 1 AND 300 THEN y END AS y FROM (SELECT event_id,
 CAST(floor((lon - (-74.913585)) * CAST(111194.92664455873 AS DOUBLE) * cos(radians(lat)) / 500.0 + 1.5) AS INTEGER) AS x, CAST(floor((41.474937 - lat) * CAST(111194.92664455873 AS DOUBLE) / 500.0 + 1.5) AS INTEGER) AS y
 FROM (SELECT event_id, {_POINT} FROM events))""")
def geo_cell(spark, d):
    x, y = geo.cell(F.col("lat"), F.col("lon"), 500.0, 300)
    return _points(spark, d).select("event_id", x.alias("x"), y.alias("y"))


@query("""SELECT x, y, round(lat, 7) AS lat, round(-74.913585 + (x - 1) * 500.0 / CAST(111194.92664455873 AS DOUBLE) / cos(radians(lat)), 7) AS lon FROM (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, 41.474937 - (y - 1) * 500.0 / CAST(111194.92664455873 AS DOUBLE) AS lat FROM range(1, 301) a(x), range(1, 301) b(y))""")
def geo_grid(spark, d):
    return geo.grid(spark, 500.0, 300).select("x", "y", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


_CORNERS = ("ne", "se", "sw", "nw")


def _corner_sql(name: str, bearing: float) -> str:
    b, s = f"radians({bearing})", f"(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians({bearing})))"
    return f"round(degrees(asin({s})), 6) AS {name}_lat, round(degrees(radians(lon) + atan2(sin({b}) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * {s})), 6) AS {name}_lon"


@query(f"""SELECT event_id, {', '.join(_corner_sql(k, 45.0 + 90 * i) for i, k in enumerate(_CORNERS))}, event_id % 50 * 10 + 5 < 250 AS inside
 FROM (SELECT event_id, {_POINT}, 500.0 / sqrt(2.0) / 6371000.0 AS d FROM events)""")
def geo_square(spark, d):
    """The square around each point, and whether it holds a point some way to the east: it does for less than half a side."""
    p = _points(spark, d)
    corners = geo.square(F.col("lat"), F.col("lon"), 500.0)
    east = geo.destination(F.col("lat"), F.col("lon"), (F.col("event_id") % 50 * 10 + 5).cast("double"), F.lit(90.0))
    names = [f"{k}_{c}" for k in _CORNERS for c in ("lat", "lon")]
    return p.select("event_id", *[F.round(c, 6).alias(n) for n, c in zip(names, corners)], geo.inside(*east, corners).alias("inside"))


@query("""SELECT event_id, CASE WHEN event_id = 0 THEN 0 ELSE event_id & -event_id END AS lowest, CASE WHEN event_id = 0 THEN 0 ELSE CAST(1 AS BIGINT) << CAST(floor(log2(event_id)) AS BIGINT) END AS highest,
 event_id & 240 AS middle, CAST(bit_count(event_id) AS INTEGER) AS ones, CASE WHEN event_id = 0 THEN 64 ELSE CAST(log2(event_id & -event_id) AS INTEGER) END AS zeros,
 CAST(list_sum(list_transform(range(32), lambda b: ((event_id >> b) & 1) << (31 - b))) AS BIGINT) AS reversed FROM events""")
def bit_functions(spark, d):
    x = F.col("event_id")
    return parquet(spark, d, "events").select(
        x, bits.lowest_bit(x).alias("lowest"), bits.highest_bit(x).alias("highest"), bits.isolate(x, 4, 4).alias("middle"), F.bit_count(x).alias("ones"), bits.trailing_zeros(x).alias("zeros"), bits.reverse32(x).alias("reversed")
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%-m-%-d') AS day, datediff('second', TIMESTAMP '1992-01-01', o_orderdate) AS seconds FROM orders")
def date_functions(spark, d):
    start = F.unix_timestamp(F.lit("1992-01-01").cast("timestamp"))
    return parquet(spark, d, "orders").select("o_orderkey", sinks.unpadded_date(F.col("o_orderdate")).alias("day"), (F.unix_timestamp("o_orderdate") - start).alias("seconds"))


@query("SELECT event_id || ',' || user_id || ',' || event_type AS line FROM events")
def row_lines(spark, d):
    return sinks.row_text(parquet(spark, d, "events").select("event_id", "user_id", "event_type"))


@query("SELECT CAST(floor(value) AS BIGINT) AS v, count(*) AS n, repeat('*', CAST(floor(count(*) / 200.0) AS BIGINT)) AS bar FROM events GROUP BY 1")
def histogram(spark, d):
    from ..sources.synthetic import histogram as bars

    return bars(parquet(spark, d, "events").select(F.floor("value").alias("v")))
