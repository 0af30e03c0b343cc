"""Mixing sources to target weights by capped water-filling.

Source targets start proportional to the weights; a source whose target would pass its cap (maximum
epochs times its size) is clamped there and the excess goes to the others by weight until none is above.
Sorted by cap over weight, the clamped sources are a prefix, so the end state of that redistribution is
found with one running sum over the sources. A source's target is then met by whole repetitions of every
document plus one fractional repetition: the documents that a seeded hash ranks first, up to the words
still missing. DataFrame operations only.

Defined results: a null or blank text has size 0 and takes 0; a null source is a source of its own and
comes last; rows without doc_id are ranked by a hash of their text; ties of the rank (one id) go by size, then
by a hash of the text, and rows equal in all these are alike; a document of any length is taken whole or not;
an empty table gives an empty result; an all-zero corpus has targets 0; other columns are not read (the stage
returns them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
HASH_PREFIX = 3  # hex digits: 4096 buckets a source


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size), one row a source, to (source, source_size, target).

    Runs over one row per source; the number of sources does not follow the number of documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.select("source", "source_size", rank.alias("place"), w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    all_rows = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "place")
    s = s.withColumn("capped", F.sum("cap").over(order) - F.col("cap"))
    s = s.withColumn("free", F.sum("w").over(all_rows) - (F.sum("w").over(order) - F.col("w")))
    s = s.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.col("capped")) / F.col("free"))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("final", level)
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("final") * F.col("w"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix-1", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with how often the mix repeats it.

    The fractional repetition of a source takes documents in the order of a seeded hash. Hash prefixes are
    summed first (4096 buckets a source), so only the one bucket that holds the cut is ranked row by row.
    """
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    h = F.md5(F.concat(F.lit(f"{seed}:"), own))
    rows = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th"), h.alias("h"))
    rows = rows.withColumn("bucket", F.substring("h", 1, HASH_PREFIX))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), share, epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bucket")
    b = buckets.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    b = b.withColumnsRenamed({"source": "b_source", "bucket": "b_bucket"})
    targets = targets.withColumnRenamed("source", "t_source")
    b = b.join(targets, F.col("b_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    b = b.withColumn("cut", F.when(F.col("before") + F.col("words") <= F.col("missing"), F.lit(1)).when(F.col("before") >= F.col("missing"), F.lit(0)))
    rows = rows.join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))).drop("b_source", "b_bucket")
    edge = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "th")
    at = F.col("before") + F.sum("size").over(edge.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / F.lit(2.0)
    settled = rows.where("cut IS NOT NULL").withColumn("extra", F.col("cut").cast("long"))
    ranked = rows.where("cut IS NULL").withColumn("extra", F.when(at < F.col("missing"), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return settled.unionByName(ranked).withColumn("repeats", F.col("whole") + F.col("extra")).drop("h", "th", "bucket", "words", "before", "cut", "extra", "whole", "missing")


def op10_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix repeats it (blank documents, which take nothing, stay once)."""
    row = "row"
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mixed = mix(docs.select("doc_id", "source", "text", whole.alias(row)), keep=(row,))
    times = F.when(F.col("size") > 0, F.col("repeats")).otherwise(F.lit(1)).cast("int")
    out = mixed.select(row, F.explode(F.array_repeat(F.lit(True), times)))
    return out.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


ORACLE_MIX = r"""
rows AS (
  SELECT d.*, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || COALESCE(CAST(doc_id AS VARCHAR), 't' || md5(COALESCE(text, '')))) AS h
  FROM {docs} d),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place,
         CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
         source_size * CAST(2 AS DOUBLE) AS cap
  FROM src),
running AS (
  SELECT *, (SELECT sum(source_size) FROM weighed) * CAST(1.5 AS DOUBLE) AS pool,
         sum(cap) OVER o - cap AS capped, (SELECT sum(w) FROM weighed) - (sum(w) OVER o - w) AS free
  FROM weighed WINDOW o AS (ORDER BY cap / w, place)),
level AS (SELECT arg_min((pool - capped) / free, (cap / w, place)) AS lv FROM running WHERE (pool - capped) / free * w <= cap),
targets AS (SELECT source, source_size, COALESCE(least(lv * w, cap), cap) AS target FROM running, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS missing,
         sum(r.size) OVER b - sum(r.size) OVER bb AS before, sum(r.size) OVER bb AS words,
         sum(r.size) OVER e - r.size / CAST(2 AS DOUBLE) AS reach
  FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
  WINDOW b AS (PARTITION BY r.source ORDER BY substr(r.h, 1, 3)), bb AS (PARTITION BY r.source, substr(r.h, 1, 3)),
         e AS (PARTITION BY r.source ORDER BY r.h, r.doc_id, r.size ROWS UNBOUNDED PRECEDING)),
mixed AS (
  SELECT *, whole + CASE WHEN before + words <= missing THEN 1 WHEN before >= missing THEN 0 WHEN reach < missing THEN 1 ELSE 0 END AS repeats FROM placed)
"""

QUERIES = {"op10_capped_water_filling": op10_capped_water_filling}
ORACLE = {
    "op10_capped_water_filling": "WITH " + ORACLE_MIX.replace("{docs}", "documents")
    + "SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken FROM mixed"
}
