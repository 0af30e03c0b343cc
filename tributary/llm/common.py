"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        home = sc.getConf().get("spark.checkpoint.dir")
        if not home and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(home or tempfile.mkdtemp(prefix="tributary-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Columnar and compressed, so better than ``cut`` for wide or large intermediate results
    that several later steps read.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows (counts no further than that)."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it, else as it is (a shuffled join)."""
    return F.broadcast(df) if small(df, limit) else df


def attach(rows: DataFrame, on: list[str], values: DataFrame, total: int, count: str = "n", least: int = 256) -> DataFrame:
    """Inner join of ``rows`` with ``values``, unique by ``on``, whose column ``count`` says how many rows each key has.

    Keys with more than a five-hundredth of the ``total`` rows are joined by broadcast, so no task gets such a key's rows;
    there are at most five hundred of them. Without such a key this is a plain join.
    """
    many = F.col(count) > max(least, total // 500)
    hot = values.where(many)
    if not hot.limit(1).count():
        return rows.join(values, on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(values.where(~many), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def by_block(compare, *keys: str):
    """``mapInPandas`` function that gives whole blocks, rows equal in ``keys`` (integers), to ``compare(rows, cuts)``.

    The rows of a partition come sorted by the keys; block n is rows cuts[n] to cuts[n + 1].
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # the block that the last batch ended in
        for b in batches:
            if not len(b):
                continue
            rows = pd.concat([*kept, b], ignore_index=True)
            k = rows[list(keys)].to_numpy(np.int64)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            kept = [rows]
            if len(cuts):
                yield compare(rows.iloc[: cuts[-1]], np.r_[0, cuts])
                kept = [rows.iloc[cuts[-1] :].reset_index(drop=True)]
        if kept:
            yield compare(kept[0], np.array([0, len(kept[0])]))

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
