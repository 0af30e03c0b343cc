"""The corpus pipeline: quality, near-duplicates, decontamination, mixing and sharding, one after another.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import shared_dir, table
from tributary.llm.decontamination import decontamination_stage
from tributary.llm.mixing import mixing_stage
from tributary.llm.quality import quality_stage
from tributary.llm.sharding import sharding_stage
from tributary.llm.simhash import simhash_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is a table in the shared folder before the next stage reads it."""
    docs, home = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
