"""Small document tables for the operator tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, key long, c string, y int, score double, marks string, bucket string, p int"


def words(n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    same, long = words(120, 1), words(30_000, 2)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (4, same, "en", "b", len(same)), (4, same, "en", "b", len(same)),
        (5, same, "fr", None, 1), (None, same, "en", "a", 1), (None, None, None, None, None), (6, long, "en", "a", len(long)), (7, "one", "en", "c", 3), (8, "one two", "en", "c", 7),
    ]
    return rows


def frame(spark, rows=None, schema: str = DOCS):
    return spark.createDataFrame(awkward() if rows is None else rows, schema)


def clashing(spark):
    extra = (1, 2, 3, "x", 4, 0.5, "m", "b", 9)
    return spark.createDataFrame([(*r, *extra) for r in awkward()], CLASHING)


def empty(spark):
    return spark.createDataFrame([], DOCS)
