"""URL filters by a temporal list join.

A blocklist is a log of dated entries (domain, action, effective day). Each entry is valid until the
domain's next one, so the log becomes validity intervals; every capture is then joined, for its host and
each parent domain, to the interval that holds its fetch day (an as-of join written as an interval
equi-join on the domain). DataFrame operations only.

Defined results: a null or unparsable URL has a null host and is not blocked; a null fetch day matches no
interval; of several entries for a domain on one day an allowance wins; repeated captures keep a row each;
an empty list blocks nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, table

#: The dated list that the query applies: domain, action, effective day.
LIST_LOG = (
    ("adult-x.example.com", "add", "2023-11-05"),
    ("spam-farm.example.org", "add", "2024-01-20"),
    ("spam-farm.example.org", "remove", "2024-05-02"),
    ("spam-farm.example.org", "add", "2024-06-17"),
    ("cheap-pills.example.net", "add", "2024-02-11"),
    ("ads-track.example.com", "add", "2023-12-01"),
    ("ads-track.example.com", "remove", "2024-08-09"),
    ("casino-win.example.net", "add", "2024-03-03"),
    ("free-bets.example.net", "add", "2024-01-01"),
    ("free-bets.example.net", "remove", "2024-04-15"),
    ("tionsh.example.net", "add", "2024-09-01"),
    ("tionsh.example.net", "remove", "2024-09-20"),
)
CAPTURE_START, CAPTURE_DAYS = "2024-01-01", 366


def host(url):
    """Column: lower-case host of a URL without user, port and final dot; null if there is none."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(h, r"\.$", "")), F.lit(""))


def intervals(log: DataFrame) -> DataFrame:
    """``log`` (domain, action, effective) to (domain, listed_from, listed_until): while the domain is listed."""
    per_day = log.where("domain IS NOT NULL AND effective IS NOT NULL").groupBy(F.lower("domain").alias("domain"), "effective").agg(F.max("action").alias("action"))
    w = Window.partitionBy("domain").orderBy("effective")
    spans = per_day.select("domain", "action", F.col("effective").alias("listed_from"), F.lead("effective").over(w).alias("listed_until"))
    return spans.where("action = 'add'").drop("action")


def evaluate(captures: DataFrame, log: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched) with host, blocked, the most specific listed domain and its list day.

    Distinct (host, day) pairs are judged, not captures, so a host with a third of all captures costs a row a
    day; the verdicts go back by a join on the pair.
    """
    c = captures.select("page_id", host(F.col("url")).alias("host"), "fetched")
    pairs = c.where("host IS NOT NULL AND fetched IS NOT NULL").select("host", "fetched").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = pairs.select("host", "fetched", F.explode(parents).alias("domain"))
    spans = maybe_broadcast(intervals(log))
    open_end = F.col("listed_until").isNull() | (F.col("fetched") < F.col("listed_until"))
    hit = asked.join(spans, "domain").where((F.col("fetched") >= F.col("listed_from")) & open_end)
    best = F.max_by(F.struct("domain", "listed_from"), F.length("domain"))
    verdict = hit.groupBy("host", "fetched").agg(best.alias("m"))
    out = c.join(verdict, ["host", "fetched"], "left")
    return out.select("page_id", "host", "fetched", F.col("m").isNotNull().alias("blocked"), F.col("m.domain").alias("list_domain"), F.col("m.listed_from").alias("listed_from"))


def op9_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no fetch day, so a fixed rule on page_id sets one in 2024."""
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit(CAPTURE_START).cast("date"), F.pmod(F.col("page_id") * 131, F.lit(CAPTURE_DAYS)).cast("int"))
    log = spark.createDataFrame(list(LIST_LOG), "domain string, action string, day string").select("domain", "action", F.to_date("day").alias("effective"))
    out = evaluate(pages.select("page_id", "url", day.alias("fetched")), log)
    return out.withColumns({"fetched": F.col("fetched").cast("string"), "listed_from": F.col("listed_from").cast("string")})


_VALUES = ", ".join(f"('{d}', '{a}', DATE '{t}')" for d, a, t in LIST_LOG)
ORACLE = {
    "op9_temporal_list_join": f"""
WITH log(domain, action, effective) AS (VALUES {_VALUES}),
spans AS (SELECT domain, action, effective AS listed_from, lead(effective) OVER (PARTITION BY domain ORDER BY effective) AS listed_until FROM log),
c AS (SELECT page_id, nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\\.$', '')), '') AS host,
             CAST(DATE '{CAPTURE_START}' + CAST((page_id * 131) % {CAPTURE_DAYS} AS INTEGER) AS DATE) AS fetched FROM pages),
hit AS (SELECT c.host, c.fetched, s.domain, s.listed_from FROM (SELECT DISTINCT host, fetched FROM c) c JOIN spans s
        ON s.action = 'add' AND (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND c.fetched >= s.listed_from AND (s.listed_until IS NULL OR c.fetched < s.listed_until)),
best AS (SELECT host, fetched, arg_max(domain, length(domain)) AS list_domain, arg_max(listed_from, length(domain)) AS listed_from FROM hit GROUP BY 1, 2)
SELECT page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched, list_domain IS NOT NULL AS blocked, list_domain, CAST(listed_from AS VARCHAR) AS listed_from
FROM c LEFT JOIN best b ON c.host = b.host AND c.fetched = b.fetched"""
}
QUERIES = {"op9_temporal_list_join": op9_temporal_list_join}
