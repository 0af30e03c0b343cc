"""Toxicity by a linear-chain conditional random field over words.

Token labels come from the labelled documents: a word feature (the word, or a prefix or suffix of it) that
labelled-toxic training documents hold far more often than the others marks its tokens, in toxic documents, as
toxic; all other tokens are ordinary. A two-tag chain with word, prefix, suffix and neighbour-free shape
features is fitted on a bounded sample of such sequences by maximum likelihood; forward-backward marginals
give each token's probability. A document's score is a calibrated logistic of its marginals; runs of tokens
over one half are its offending offsets.

Both are fitted on bounded samples of the labelled rows: features are counted over at most ``FIT`` documents per
class, the chain and its calibration use at most ``SAMPLE`` of these (those that a hash ranks first) and of
``SAMPLE_BYTES``, whole texts. So no text is shuffled: the sample's ids are broadcast. Scoring reads all documents and whole texts.

Defined results: null and empty texts score the calibrated score of no evidence; repeated rows score alike;
null labels are not learnt from; with no labelled rows, or one class only, every score is the base rate; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents per class that features are counted over, and those of them that the chain is fitted on.
FIT, SAMPLE = 4000, 800
#: Bytes per class of the texts that the chain is fitted on; the sample ends with the text that reaches them.
SAMPLE_BYTES = 8 << 20
#: Features kept in the model, and the evidence they need.
VOCABULARY, MIN_DOCS, MIN_LOG_ODDS = 20_000, 8, 2.5


def features(word: str) -> list[str]:
    """A word's features: itself and, from five letters on, its prefixes and suffixes of three to six letters."""
    out = [word]
    n = len(word)
    out += [f"^{word[:k]}" for k in range(3, 7) if k < n]
    out += [f"{word[-k:]}$" for k in range(3, 7) if k < n]
    return out


@dataclass
class Chain:
    """Weights of the fitted chain; ``emit`` holds feature weights of the toxic tag against the ordinary one."""

    emit: dict[str, float] = field(default_factory=dict)
    bias: float = -5.0
    stay: float = 0.0  # transition weight toxic -> toxic
    calibration: tuple[float, float, float] = (1.0, 1.0, -2.0)


def _logit(p):
    return np.log(p) - np.log1p(-p)


def messages(e: list[np.ndarray], stay: float) -> tuple[list, list, list]:
    """Per sequence of emission log odds: marginals of the toxic tag, forward and backward messages with emissions.

    All sequences advance together, longest first, so one vectorised step serves every sequence still running.
    Messages are kept as log odds; transition weights are 0 but for toxic to toxic.
    """
    order = sorted(range(len(e)), key=lambda i: -len(e[i]))
    lengths = np.array([len(e[i]) for i in order], np.int64)
    steps = int(lengths[0]) if len(order) else 0
    if not steps:
        none = [np.zeros(0) for _ in e]
        return none, none, none
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    starts = np.concatenate([[0], np.cumsum(live)])
    flat = np.empty(starts[-1])  # time-major: step t's live sequences are together
    for r, i in enumerate(order):
        flat[starts[: lengths[r]] + r] = e[i]
    w = np.exp(stay)
    fwd, back = np.empty_like(flat), np.zeros_like(flat)
    fwd[: live[0]] = flat[: live[0]]
    for t in range(1, steps):
        o = np.exp(np.clip(fwd[starts[t - 1] : starts[t - 1] + live[t]], -40, 40))
        fwd[starts[t] : starts[t] + live[t]] = flat[starts[t] : starts[t] + live[t]] + np.log((1 + o * w) / (1 + o))
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        o = np.exp(np.clip(flat[starts[t + 1] : starts[t + 1] + n] + back[starts[t + 1] : starts[t + 1] + n], -40, 40))
        back[starts[t] : starts[t] + n] = np.log((1 + o * w) / (1 + o))
    p = 1 / (1 + np.exp(-np.clip(fwd + back, -40, 40)))
    out: tuple[list, list, list] = tuple([None] * len(e) for _ in range(3))
    for r, i in enumerate(order):
        own = starts[: lengths[r]] + r
        out[0][i], out[1][i], out[2][i] = p[own], np.clip(fwd[own], -40, 40), np.clip(flat[own] + back[own], -40, 40)
    return out


def marginals(e: list[np.ndarray], stay: float) -> list[np.ndarray]:
    return messages(e, stay)[0]


def fit_chain(tokens: list[np.ndarray], words: list[str], vocabulary: dict[str, float], toxic: list[bool], rounds: int = 50, l2: float = 0.02) -> Chain:
    """Maximum-likelihood weights by AdaGrad on the exact gradient (observed less expected counts).

    ``tokens`` are sequences of indices into ``words``. A token of a toxic document is observed toxic if it
    has a feature of ``vocabulary``.
    """
    names = list(vocabulary)
    at = {f: i for i, f in enumerate(names)}
    have = [[at[f] for f in features(w) if f in at] for w in words]
    rows = np.repeat(np.arange(len(words)), [len(k) for k in have])
    cols = np.array([i for k in have for i in k], np.int64)
    marked = np.array([bool(k) for k in have])
    flat, cuts = np.concatenate(tokens), np.cumsum([len(t) for t in tokens])[:-1]
    y = marked[flat] & np.repeat(np.array(toxic), [len(t) for t in tokens])
    inner = np.ones(len(flat), bool)  # tokens that have a successor in their sequence
    inner[np.r_[cuts, len(flat)] - 1] = False
    pairs = float((y[:-1] & y[1:] & inner[:-1]).sum())
    theta, bias, stay = np.zeros(len(names)), -4.0, 0.0
    g2, gb2, gs2 = np.full(len(names), 1e-6), 1e-6, 1e-6
    for _ in range(rounds):
        e = (bias + np.bincount(rows, theta[cols], minlength=len(words)))[flat]
        p, f, g_ = (np.concatenate(x) for x in messages(np.split(e, cuts), stay))
        o, q, w = np.exp(f[:-1]), np.exp(g_[1:]), np.exp(stay)
        expected = float(((o * q * w) / (1 + o + q + o * q * w))[inner[:-1]].sum())
        gap = np.bincount(flat, y - p, minlength=len(words))
        g = np.bincount(cols, gap[rows], minlength=len(names)) - l2 * theta
        gb, gs = gap.sum(), pairs - expected - l2 * stay
        g2, gb2, gs2 = g2 + g * g, gb2 + gb * gb, gs2 + gs * gs
        theta += 0.7 * g / np.sqrt(g2)
        bias += 0.7 * gb / np.sqrt(gb2)
        stay = float(np.clip(stay + 0.3 * gs / np.sqrt(gs2), -2, 4))
    return Chain({f: float(v) for f, v in zip(names, theta) if abs(v) > 1e-3}, float(bias), stay)


def _evidence(p: np.ndarray) -> tuple[float, float]:
    """What the calibration sees of a document: the largest marginal's logit and log(1 + expected toxic tokens)."""
    if not len(p):
        return -10.0, 0.0
    return float(_logit(np.clip(p.max(), 1e-6, 1 - 1e-6))), float(np.log1p(p[p > 0.02].sum()))


def emissions(tokens: list[str], chain: Chain, memo: dict[str, float]) -> np.ndarray:
    out = []
    for w in tokens:
        v = memo.get(w)
        if v is None:
            v = chain.bias + sum(chain.emit.get(f, 0.0) for f in features(w))
            if len(memo) < 500_000:
                memo[w] = v
        out.append(v)
    return np.array(out)


def calibrate(evidence: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400) -> tuple[float, float, float]:
    """Weighted logistic regression on the two kinds of evidence, by Newton steps with a small ridge."""
    x = np.c_[evidence, np.ones(len(evidence))]
    b = np.array([0.3, 0.3, -1.0])
    for _ in range(min(steps, 60)):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1e-2 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        b = b + np.clip(np.linalg.solve(h, g), -1, 1)
    return tuple(float(v) for v in b)


def train(docs: DataFrame, labels: DataFrame, fit: int = FIT, sample: int = SAMPLE) -> Chain:
    """Fit a chain from documents and their labels (doc_id, toxic), whatever rows these hold."""
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = y.join(docs.where("text IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    sizes = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        base = 0.5 if n0 == n1 else float(n1 > 0) * 0.98 + 0.01
        return Chain(calibration=(0.0, 0.0, float(_logit(base))))

    def chosen(most: int) -> DataFrame:
        ids = [y.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(most).select("doc_id", "toxic") for t in (0, 1)]
        return docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")  # at most 2 x most rows

    rows = chosen(fit)
    m0, m1 = min(n0, fit), min(n1, fit)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for i, (text, t) in enumerate(zip(b["text"], b["toxic"]), 1):
                seen[int(t)].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
                if len(seen[0]) > 200_000 or i == len(b):
                    names = list(seen[0].keys() | seen[1].keys())
                    yield pd.DataFrame({"f": names, "n0": [seen[0][f] for f in names], "n1": [seen[1][f] for f in names]})
                    seen = (Counter(), Counter())

    counts = rows.mapInPandas(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (m1 + 1.0)) - F.log((F.col("n0") + 0.5) / (m0 + 1.0))
    least = max(3, min(MIN_DOCS, m1 // 10))
    best = counts.select("f", odds.alias("odds"), "n1").where((F.col("odds") > MIN_LOG_ODDS) & (F.col("n1") >= least))
    vocabulary = {r["f"]: r["odds"] for r in best.orderBy(F.desc(F.col("odds") * F.log1p("n1")), "f").limit(VOCABULARY).collect()}
    index: dict[str, int] = {}
    tokens, truth = [], []
    upto = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    bounded = chosen(sample).withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(upto), F.lit(0))).where(F.col("before") < SAMPLE_BYTES)
    for r in bounded.orderBy("doc_id", F.xxhash64("text")).collect():
        tokens.append(np.array([index.setdefault(w, len(index)) for w in WORD.findall(r["text"].lower())], np.int32))
        truth.append(bool(r["toxic"]))
    words = list(index)
    chain = fit_chain(tokens, words, vocabulary, truth)
    memo: dict[str, float] = {}
    each = emissions(words, chain, memo)
    ev = np.array([_evidence(p) for p in marginals([each[t] for t in tokens], chain.stay)])
    y_ = np.array(truth, float)
    weight = np.where(y_ > 0, n1 / max(1, y_.sum()), n0 / max(1, (1 - y_).sum())) / (n0 + n1) * len(y_)
    chain.calibration = calibrate(ev, y_, weight)
    return chain


def _parts(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """``texts`` in order, in lists of at most ``most`` characters, or one text."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > most:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, score, n_toxic, spans) of every document; spans are code-point offsets start:end of tagged runs."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most VOCABULARY features

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, memo = sent.value, {}
        a, b_, c0 = c.calibration
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            ps = []
            for part in _parts(texts):
                ps += marginals([emissions(WORD.findall(t.lower()), c, memo) for t in part], c.stay)
            scores, counts, spans = [], [], []
            for text, p in zip(texts, ps):
                x, y = _evidence(p)
                scores.append(1 / (1 + np.exp(-np.clip(a * x + b_ * y + c0, -30, 30))))
                hit = np.flatnonzero(p >= 0.5)
                counts.append(len(hit))
                spans.append(_offsets(text, hit) if len(hit) else "")
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": scores, "n_toxic": counts, "spans": spans})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, n_toxic int, spans string")


def _offsets(text: str, hit: np.ndarray) -> str:
    at = [m.span() for m in WORD.finditer(text)]
    if len(at) <= int(hit[-1]):  # lower-casing changed the number of words; place them in the lower-case text
        at = [m.span() for m in WORD.finditer(text.lower())]
    out: list[list[int]] = []
    last = -2
    for i in hit.tolist():
        if i == last + 1:
            out[-1][1] = at[i][1]
        else:
            out.append(list(at[i]))
        last = i
    return ",".join(f"{s}:{e}" for s, e in out)


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    chain = train(docs.where(~held), labels.where(~held))
    s = score(docs, chain)
    return s.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")


QUERIES = {"op3_crf_toxicity": op3_crf_toxicity}
ORACLE: dict[str, str] = {}
