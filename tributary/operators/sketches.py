"""Cardinality estimators: exact sets, HIP registers, and the built-in HLL sketches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the register hash: multiplier, increment and bucket bits.
HIP_MULTIPLIER, HIP_INCREMENT, HIP_BITS = 9223372036854775837, 1234567890123456789, 12
_M64 = (1 << 64) - 1


class ExactCardinality:
    """Distinct count by a set."""

    def __init__(self) -> None:
        self.seen: set = set()

    def insert(self, code) -> None:
        self.seen.add(code)

    def count(self) -> int:
        return len(self.seen)

    def what_if(self, code) -> int:
        """The count as if ``code`` were inserted."""
        return len(self.seen) + (code not in self.seen)

    def copy(self):
        new = type(self)()
        new.seen = set(self.seen)
        return new


class HipCardinality:
    """Historic-inverse-probability estimate over 2^bits registers of five bits (kept as bytes)."""

    def __init__(self, bits: int = HIP_BITS) -> None:
        self.bits, self.size = bits, 1 << bits
        self.registers = np.zeros(self.size, np.uint8)
        self.estimate, self.mass = 0.0, float(self.size)

    def _place(self, code: int) -> tuple[int, int]:
        h = (code * HIP_MULTIPLIER + HIP_INCREMENT) & _M64
        rest = h >> self.bits
        zeros = (rest & -rest).bit_length() - 1 if rest else 64
        return h & (self.size - 1), min(zeros + 1, 31)

    def insert(self, code: int) -> None:
        at, rank = self._place(code)
        old = int(self.registers[at])
        if rank > old:
            self.estimate += self.size / self.mass
            self.mass += (2.0**-rank if rank < 31 else 0.0) - 2.0**-old
            self.registers[at] = rank

    def count(self) -> int:
        return round(self.estimate)

    def what_if(self, code: int) -> int:
        at, rank = self._place(code)
        return round(self.estimate + (self.size / self.mass if rank > self.registers[at] else 0.0))

    def copy(self):
        new = HipCardinality(self.bits)
        new.registers, new.estimate, new.mass = self.registers.copy(), self.estimate, self.mass
        return new


def hip_distinct(df: DataFrame, group: str, key: str) -> DataFrame:
    """HIP estimate of distinct keys per group. Repeats never change it, so distinct pairs are streamed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sketch = HipCardinality()
        for code in pdf["code"]:
            sketch.insert(int(code) & _M64)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "estimate": [sketch.count()]})

    kind = dict(df.dtypes)[group]
    return df.select(group, F.xxhash64(key).alias("code")).distinct().groupBy(group).applyInPandas(run, f"{group} {kind}, estimate long")


def hll_distinct(df: DataFrame, group: str, key: str, lg_k: int = 12) -> DataFrame:
    """HLL estimate of distinct keys per group, merged from partial sketches."""
    return df.groupBy(group).agg(F.hll_sketch_estimate(F.hll_sketch_agg(key, F.lit(lg_k))).alias("estimate"))


def hll_what_if(sketches: DataFrame, sketch: Column, one: Column) -> DataFrame:
    """Estimates of ``sketch`` as if the one-value sketch ``one`` were added, without changing it."""
    return sketches.withColumn("what_if", F.hll_sketch_estimate(F.hll_union(sketch, one)))
