"""Quality by co-training two views of a document.

The text view sees what the words are like (character classes, repetition, word shapes, common words); the
metadata view sees what a crawler knows of the page (source, language, size, layout of lines). Each view is a
logistic regression. Both start from the labelled rows. In every round both views score all other documents, global
quantiles of the scores say which ones a view is surest of at either end, a share that grows with the rounds, and
those are pseudo-labels for the *other* view. It learns from all of them: their gradients are summed over the
cluster, on top of the labelled rows'. Held-out labelled rows then calibrate each view (Platt scaling) and a
combined view over both logits.

The labelled rows used are at most ``LABELLED`` per class, those that a hash ranks first, whole texts. Everything else
covers all documents: their features are computed once, into a table in the shared folder, and read in every round.
The views share no feature: the page view sees the size and layout of lines, source and language, the text view what
the words are like.

Defined results: null and empty texts are scored by their (empty) features; null source or language is a
category of its own; null labels are not learnt from; with no labelled rows, or one class, nothing is
rejected; repeated rows score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

LABELLED, ROUNDS = 2000, 4
#: Share of all documents that each view hands over in the first round; in round r it is r times that.
GROWTH = 0.05
#: Weight of all pseudo-labels of a class against the labelled rows of one, passes over them in a round, and the least logit.
PSEUDO, PASSES, SURE = 0.25, 2, 1.0
#: A document is rejected below this calibrated probability of good quality.
REJECT = 0.5
_HASHED = 256  # dimensions of hashed word beginnings and, in the other view, of sources and languages

_CLASS = np.full(256, 7, np.uint8)
_CLASS[[ord(c) for c in " \t\n\r\v\f"]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[[ord(c) for c in "!#$%&*|<>=_~^{}[]\\/@+"]] = 6


def text_view(text: str) -> np.ndarray:
    """Dense features of what is written: shares and repetition, then hashed word beginnings."""
    data = text.encode("utf-8", "replace")
    hist = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8) / max(1, len(data))
    words = data.split()
    n = len(words)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    longest = most = 0
    if n:
        run = 1
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            if run > longest:
                longest = run
        lead: dict[bytes, int] = {}
        for w in words:
            lead[w[-3:]] = lead.get(w[-3:], 0) + 1
        most = max(lead.values())
        short = sum(k for w, k in lead.items() if len(w) <= 2)
        hashed = np.zeros(_HASHED)
        for w, k in lead.items():
            hashed[zlib.crc32(w) % _HASHED] += k
        hashed = np.sqrt(hashed / n)
    else:
        short, hashed = 0, np.zeros(_HASHED)
    m = max(1, n)
    dense = [*hist, distinct / m, pairs / m, np.log1p(longest), most / m, short / m, np.log1p(len(data) / m), np.log1p(n), float(n == 0)]
    return np.r_[dense, hashed * 0.5]


def page_view(text: str, source, lang) -> np.ndarray:
    """Features of the page around the words: size, line layout, and hashed source and language."""
    lines = text.split("\n")
    sizes = np.array([len(x) for x in lines])
    n = len(lines)
    dense = [
        np.log1p(len(text)), np.log1p(n), np.log1p(sizes.mean()), np.log1p(sizes.max()), sizes.std() / (1 + sizes.mean()), len(set(lines)) / n,
        sum(x[-1:] in ".!?" for x in lines) / n, sum(" | " in x for x in lines) / n, sum(x.isupper() for x in lines) / n, float(not text),
    ]
    hashed = np.zeros(_HASHED)
    hashed[zlib.crc32(f"s:{source}".encode()) % _HASHED] = 1
    hashed[zlib.crc32(f"l:{lang}".encode()) % _HASHED] = 1
    return np.r_[dense, hashed * 0.3]


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    platt: tuple[float, float] = (1.0, 0.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 25, ridge: float = 2.0) -> View:
    """Logistic regression by Newton steps; classes weigh alike."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = w * np.where(y > 0, 0.5 / max(1e-9, (w * y).sum()), 0.5 / max(1e-9, (w * (1 - y)).sum())) * w.sum()
    b, r = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    r[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (w * (y - p)) - r * b
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(r)
        d = np.linalg.solve(h, g)
        b += d * min(1.0, 5 / (np.abs(d).max() + 1e-9))
        if np.abs(d).max() < 1e-4:
            break
    return View(mean, scale, b)


def platt(s: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic fit of ``y`` on the columns of ``s`` with row weights; the last one is the intercept."""
    z = np.c_[s, np.ones(len(s))]
    b = np.r_[np.full(z.shape[1] - 1, 0.5 / max(1, z.shape[1] - 1)), 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.clip(np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b)), z.T @ (w * (y - p)) - ridge * b), -2, 2)
    return b


@dataclass
class CoTrained:
    text: View | None = None
    page: View | None = None
    combine: np.ndarray | None = None
    handed: tuple[int, ...] = ()

    def score(self, xt: np.ndarray, xp: np.ndarray) -> np.ndarray:
        """(text, page, combined) calibrated probabilities of good quality, one row each."""
        if self.text is None or self.page is None or self.combine is None:
            return np.ones((len(xt), 3))
        a, b = self.text.logit(xt), self.page.logit(xp)
        one = [v.platt[0] * s + v.platt[1] for v, s in ((self.text, a), (self.page, b))]
        both = np.c_[np.clip(np.c_[one[0], one[1]], -12, 12), np.ones(len(a))] @ self.combine
        return 1 / (1 + np.exp(-np.clip(np.c_[one[0], one[1], both], -30, 30)))


def _features(rows: DataFrame) -> DataFrame:
    """(doc_id, y, h, t, p): both views' features of ``rows`` as packed half floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "y": b["y"].astype("Int32"), "h": b["h"].astype("Int64"), "t": [text_view(t).astype(np.float16).tobytes() for t in texts],
                "p": [page_view(t, s, g).astype(np.float16).tobytes() for t, s, g in zip(texts, b["source"], b["lang"])],
            })

    return rows.select("doc_id", "y", "h", "text", "source", "lang").mapInPandas(run, "doc_id long, y int, h long, t binary, p binary")


def _matrix(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float16).reshape(len(packed), -1).astype(float)


def _logits(views: list[View]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"a": views[0].logit(_matrix(b["t"])), "b": views[1].logit(_matrix(b["p"]))})

    return run


def _pull(views: list[View], judges: list[View], cuts: list[tuple[float, float]]):
    """Gradients of the rows that the other view's logit puts beyond its cuts: (place, v) rows, summed per task.

    For each view and class, the sum of (label - probability) times the features, and the number of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if not len(b):
                continue
            x = [_matrix(b["t"]), _matrix(b["p"])]
            sure, parts = [judges[k].logit(x[k]) for k in range(2)], []
            for k in range(2):
                low, high = cuts[1 - k]
                for y, rows in ((0, sure[1 - k] <= low), (1, sure[1 - k] >= high)):
                    z = np.c_[(x[k][rows] - views[k].mean) / views[k].scale, np.ones(int(rows.sum()))]
                    parts += [z.T @ (y - 1 / (1 + np.exp(-np.clip(z @ views[k].weights, -30, 30)))), [len(z)]]
            part = np.concatenate(parts)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total), dtype=np.int32), "v": total})

    return run


def co_train(lt, lp, y, rest: DataFrame, rounds: int = ROUNDS, growth: float = GROWTH, share: float | None = None) -> CoTrained:
    """Co-training from labelled features (lt, lp, y) and the features ``rest`` (t, p) of all other documents.

    A fifth of the labels calibrates; ``share`` is that of good documents among all labels, to which calibration
    weighs the sample's classes. Per pass, some thousand sums reach the driver, whatever the number of documents.
    """
    if not len(y) or y.min() == y.max():
        return CoTrained()
    held = np.arange(len(y)) % 5 == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.ones(len(y), bool)
        seen = held
    else:
        seen = ~held
    base, own, ys = y[seen].mean(), (lt, lp), y[seen]
    each = np.where(ys > 0, 0.5 / base, 0.5 / (1 - base))  # classes weigh alike
    views, handed = [fit(x[seen], ys, np.ones(len(ys))) for x in own], []
    for r in range(1, rounds + 1):
        judges, n_all = views, 0
        ends = [growth * r * (1 - base), 1 - growth * r * base]
        q = rest.select("t", "p").mapInPandas(_logits(judges), "a double, b double").agg(*[F.percentile_approx(c, ends, 10_000).alias(c) for c in "ab"]).first()
        if q["a"] is None:
            break
        cuts = [(min(q[c][0], -SURE), max(q[c][1], SURE)) for c in "ab"]
        for _ in range(PASSES):
            sums = rest.select("t", "p").mapInPandas(_pull(views, judges, cuts), "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()
            flat, at, new, n_all = np.array([row["v"] for row in sums]), 0, [], 0
            for k, v in enumerate(views):
                z = np.c_[(own[k][seen] - v.mean) / v.scale, np.ones(len(ys))]
                p = 1 / (1 + np.exp(-np.clip(z @ v.weights, -30, 30)))
                ridge = np.full(z.shape[1], 2.0)
                ridge[-1] = 1e-3
                g, heavy, d = z.T @ (each * (ys - p)), 1.0, z.shape[1]
                for _class in range(2):
                    pull, n = flat[at : at + d], flat[at + d]
                    at, n_all = at + d + 1, n_all + int(n)
                    if n:
                        weight = min(PSEUDO * len(ys) / 2, n)  # a document weighs no more than a label
                        g, heavy = g + pull * weight / n, heavy + weight / len(ys)
                step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z * heavy + np.diag(ridge), g - ridge * v.weights)
                new.append(View(v.mean, v.scale, v.weights + step * min(1.0, 1 / (np.abs(step).max() + 1e-9))))
            views = new
        handed.append(n_all)
    share = y.mean() if share is None else share
    w = np.where(y[held] > 0, share / y[held].mean(), (1 - share) / (1 - y[held].mean()))
    for v, x in zip(views, own):
        b = platt(v.logit(x[held])[:, None], y[held], w)
        v.platt = (float(max(b[0], 1e-3)), float(b[1]))
    both = np.c_[tuple(np.clip(v.platt[0] * v.logit(x[held]) + v.platt[1], -12, 12) for v, x in zip(views, own))]
    return CoTrained(views[0], views[1], platt(both, y[held], w), tuple(handed))


def features(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[DataFrame, float | None]:
    """The table (doc_id, y, h, t, p) of all documents, ``y`` given for the labelled sample only, and the share of good labels."""
    y = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    d = docs.select("doc_id", "text", "source", "lang")
    known = y.join(d.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64(F.lit(7), "doc_id"))
    parts = [known.where(F.col("y") == k).orderBy("h", "doc_id").limit(labelled) for k in (0, 1)]
    rows = d.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id", "left")  # at most 2 x labelled rows
    return stage(_features(rows), "features"), y.agg(F.avg("y")).first()[0]


def fit_views(feats: DataFrame, share: float | None) -> CoTrained:
    got = feats.where("y IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("h", "doc_id").select("y", "t", "p").toPandas()
    if not len(got):
        return CoTrained()
    return co_train(_matrix(got["t"]), _matrix(got["p"]), got["y"].to_numpy(float), feats.where("y IS NULL"), share=share)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained:
    return fit_views(*features(docs, labels, labelled))


def score_features(feats: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, text_score, page_score, score) of every row of ``features``."""
    sent = feats.sparkSession.sparkContext.broadcast(model)  # some hundred weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = sent.value.score(_matrix(b["t"]), _matrix(b["p"])) if len(b) else np.zeros((0, 3))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_score": s[:, 0], "page_score": s[:, 1], "score": s[:, 2]})

    return feats.select("doc_id", "t", "p").mapInPandas(run, "doc_id long, text_score double, page_score double, score double")


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, text_score, page_score, score) for every document, in one pass without shuffle."""
    none = F.lit(None)
    return score_features(_features(docs.select("doc_id", "text", "source", "lang", none.cast("int").alias("y"), none.cast("long").alias("h"))), model)


def score_column(model: CoTrained, spark: SparkSession):
    """Function of the columns text, source and lang: the combined score, of the features as ``score`` has them."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def combined(text: pd.Series, source: pd.Series, lang: pd.Series) -> pd.Series:
        out, rows = [np.zeros(0)], [(t or "", s, g) for t, s, g in zip(text, source, lang)]
        for at in range(0, len(rows), 500):
            part = rows[at : at + 500]
            views = np.stack([text_view(t) for t, _, _ in part]), np.stack([page_view(*x) for x in part])
            out.append(sent.value.score(*(v.astype(np.float16).astype(float) for v in views))[:, 2])
        return pd.Series(np.concatenate(out))

    return combined


def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats, share = features(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_features(feats, fit_views(feats, share)).withColumn("kept", F.col("score") >= REJECT)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the combined view does not reject; all columns stay as they are."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_column(model, spark)("text", "source", "lang") >= REJECT)


QUERIES = {"op7_cotrained_quality": op7_cotrained_quality}
ORACLE: dict[str, str] = {}
