"""Exact substring de-duplication with a run-length index.

Every byte covered by a ``length``-byte string that also starts somewhere else is removed. Three steps:

1. Anchors. In every window of ``length`` bytes the least hash of its ``GRAM``-byte grams is that window's
   anchor, so equal windows have equal anchors at equal offsets. Successive windows with one anchor form a
   context. A context that occurs twice is repeated as a whole; an anchor with a single context is unique.
   No text is moved for either.
2. Run-length index. The different contexts of one anchor can still share windows. They are gathered in
   shards of bounded size. A shard's contexts get one suffix order and its run-compressed Burrows-Wheeler
   transform; the suffixes at run ends are sampled with their common prefixes, and the matching statistics of
   all positions are streamed from those samples (between samples they fall by one a byte).
3. Removal. The marked windows of a document are merged and cut out.

The contexts of one anchor that exceed a shard are dealt by longer anchors: a context's windows reach far to the left
of the anchor or far to the right, so it falls into two, each with the anchor extended to that side by half of
what the windows have besides. Equal windows stay together; contexts that became equal are settled by count; the rest
goes to shards, or is dealt again. After nine such steps an anchor is a whole window, so every shard is bounded. Each step
gives two rows a context at most, and steps beyond the first see only what still exceeds a shard.

Two contexts count as equal if their anchors' hashes and their own agree, 128 bits in all; in shards bytes are compared.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; repeated rows repeat each
other; a null doc_id is an id like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, stage, table

LENGTH, GRAM = 400, 128
#: Bytes of context per index shard.
SHARD_BYTES = 512 << 10
#: Bytes hashed at once; longer texts are walked in overlapping pieces.
PIECE = 1 << 20

_TABLE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from every position, by doubling."""
    h, size = _TABLE[buf], 1
    while size < gram:
        h = h[:-size] * _MUL + h[size:]
        h ^= h >> np.uint64(32)
        h *= _MIX
        size *= 2
    return h


def window_anchors(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window start the position of the leftmost least gram hash in it, and all gram hashes."""
    h = gram_hashes(buf, gram)
    width, v, at, span = length - gram + 1, h, np.arange(len(h), dtype=np.int32), 1

    def join(v, at, shift):
        right = v[shift:] < v[:-shift]
        return np.minimum(v[:-shift], v[shift:]), np.where(right, at[shift:], at[:-shift])

    while span * 2 <= width:
        v, at = join(v, at, span)
        span *= 2
    if width > span:
        v, at = join(v, at, width - span)
    return at, h


def contexts(text: bytes, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE):
    """Arrays (anchor, context hash, first window start, windows) of a text's contexts, in order."""
    out: list[tuple] = []
    step = max(piece, 2 * length)
    for base in range(0, max(0, len(text) - length + 1), step):
        part = text[base : base + step + length - 1]
        at, h = window_anchors(np.frombuffer(part, np.uint8), length, gram)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        n = np.diff(np.r_[first, len(at)])
        view, digest = memoryview(part), xxhash.xxh64_intdigest
        ctx = np.array([digest(view[s : s + k + length - 1]) for s, k in zip(first.tolist(), n.tolist())], np.uint64)
        out.append((h[at[first]].view(np.int64), ctx.view(np.int64), first.astype(np.int64) + base, n.astype(np.int64)))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def merge(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges [start, start + n), as maximal ranges."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate((start + n)[order])
    new = np.r_[True, s[1:] > e[:-1]]
    first = np.flatnonzero(new)
    return s[first], np.r_[e[first[1:] - 1], e[-1:]] - s[first]


_OCC = "anchor long, ctx long, cnt int, doc_id long, th long, start int, n int"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per different context of a document; rows without anchor are ranges repeated within the document."""
    for b in batches:
        rows: list[tuple] = []
        held = 0
        for doc, th, text in zip(b["doc_id"].astype("Int64"), b["th"], b["text"]):
            a, c, s, n = contexts((text or "").encode("utf-8", "replace"))
            if len(a):
                key = a.view(np.uint64) * _MUL ^ c.view(np.uint64)
                _, first, inverse, cnt = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                rows.append((a[first], c[first], cnt, doc, th, s[first], n[first]))
                if len(first) < len(a):
                    twice = cnt[inverse] > 1
                    ms, mn = merge(s[twice], n[twice])
                    rows.append((None, None, np.zeros(len(ms), int), doc, th, ms, mn))
                held += len(first)
            if held > 100_000:
                yield _frame(rows)
                rows, held = [], 0
        if rows:
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    size = [len(r[2]) for r in rows]

    def ids(k):
        return pd.array(np.concatenate([np.zeros(m, np.int64) if r[k] is None else r[k] for r, m in zip(rows, size)]), dtype="Int64")

    none = np.repeat([r[0] is None for r in rows], size)
    a, c = ids(0), ids(1)
    a[none], c[none] = pd.NA, pd.NA
    doc = pd.array([r[3] for r in rows], dtype="Int64")
    return pd.DataFrame({
        "anchor": a, "ctx": c, "cnt": np.concatenate([r[2] for r in rows]), "doc_id": doc.repeat(size), "th": np.repeat([r[4] for r in rows], size),
        "start": np.concatenate([r[5] for r in rows]), "n": np.concatenate([r[6] for r in rows]),
    })


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of several strings, with the suffixes at run ends sampled.

    Each string has an end mark of its own, so no match crosses strings.
    """

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], np.int64)
        self.text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        n, m = len(self.text), len(strings)
        ends = self.starts + size
        self.left = np.repeat(ends, size + 1) - np.arange(n)  # bytes up to the string's end
        symbols = self.text.astype(np.int64) + m
        symbols[ends] = np.arange(m)
        order = self._suffix_order(symbols, int(size.max(initial=0)) + 1)
        before = symbols[order - 1]  # the transform; position 0 wraps to the last mark, which nothing else equals
        head = np.r_[True, before[1:] != before[:-1]]
        tail = np.r_[head[1:], True]
        i = np.flatnonzero(head)
        self.runs = len(i)
        self.heads, self.head_lcp = order[i], np.zeros(len(i), np.int64)
        self.head_lcp[1:] = self._common(order[i[1:]], order[i[1:] - 1])
        i = np.flatnonzero(tail)
        self.tails, self.tail_lcp = order[i], np.zeros(len(i), np.int64)
        self.tail_lcp[:-1] = self._common(order[i[:-1]], order[i[:-1] + 1])

    @staticmethod
    def _suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
        """Suffix order by prefix doubling; the marks differ, so ``longest`` symbols decide every comparison."""
        n = len(symbols)
        bits = int(symbols.max(initial=1)).bit_length()
        pack = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for k in range(pack):
            key <<= bits
            key[: max(0, n - k)] |= symbols[k:]
        done = pack
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
            if done >= longest or rank[order[-1]] == n - 1:
                return order
            key = rank << 31
            key[: max(0, n - done)] |= rank[done:] + 1
            done *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at ``a`` and ``b``, within their strings."""
        most = np.minimum(self.left[a], self.left[b])
        pad = np.r_[self.text, np.zeros(8, np.uint8)]
        eight = np.lib.stride_tricks.sliding_window_view(pad, 8)
        out, live, at = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(live):
            same = (eight[np.minimum(a[live] + at, len(self.text))] == eight[np.minimum(b[live] + at, len(self.text))])
            run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
            out[live] = np.minimum(at + run, most[live])
            at += 8
            live = live[(run == 8) & (most[live] > at)]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every text position the longest match with a suffix elsewhere, streamed from the samples in text order."""
        out = np.zeros(len(self.text), np.int64)
        for at, lcp in ((self.heads, self.head_lcp), (self.tails, self.tail_lcp)):
            value = np.full(len(self.text), -1, np.int64)
            value[at] = lcp + at
            place = np.where(value >= 0, np.arange(len(value)), 0)
            np.maximum.accumulate(place, out=place)
            out = np.maximum(out, value[place] - np.arange(len(value)))
        return np.minimum(out, self.left)


def repeated_starts(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string the positions whose ``length`` bytes also start elsewhere in the strings."""
    index = RunLengthIndex(strings)
    hit = index.matching_statistics() >= length
    return [np.flatnonzero(hit[s : s + len(x)]) for s, x in zip(index.starts, strings)]


_MARK = "doc_id long, th long, start int, n int"


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.reset_index(drop=True)
    found = repeated_starts(pdf["piece"].tolist())
    out = []
    for (doc, th, s, c), hit in zip(zip(pdf["doc_id"].astype("Int64"), pdf["th"], pdf["start"], pdf["c"]), found):
        if c == 1 and len(hit):
            ms, mn = merge(hit, np.ones(len(hit), np.int64))
            out += [(doc, th, s + int(a), int(b)) for a, b in zip(ms, mn)]
    r = pd.DataFrame(out, columns=["doc_id", "th", "start", "n"])
    return r.astype({"doc_id": "Int64", "th": "int64", "start": "int32", "n": "int32"})


_PIECES = "shard int, anchor long, c long, doc_id long, th long, start int, n int, g int, piece binary"


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Frames of ``_PIECES`` rows, of some megabytes each."""
    cols, held, out = [c.split()[0] for c in _PIECES.split(", ")], 0, []
    for row in rows:
        out.append(row)
        held += len(row[-1])
        if held > 8 << 20:
            yield pd.DataFrame(out, columns=cols).astype({"shard": "Int32", "doc_id": "Int64"})
            held, out = 0, []
    if out:
        yield pd.DataFrame(out, columns=cols).astype({"shard": "Int32", "doc_id": "Int64"})


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each wanted context."""

    def rows():
        for b in batches:
            for doc, th, text, want in zip(b["doc_id"].astype("Int64"), b["th"], b["text"], b["want"]):
                data = (text or "").encode("utf-8", "replace")
                for w in want:
                    s, n = w["start"], w["n"]
                    yield w["shard"], w["anchor"], w["c"], doc, th, s, n, -1, data[s : s + n + LENGTH - 1]

    return _frames(rows())


def halves(piece: bytes, n: int, g: int, size: int) -> list[tuple[int, int, int, int]]:
    """(side, first window, windows, anchor's place) of a context's halves, for an anchor of ``size`` bytes at ``g`` that grows by half the rest.

    Windows that reach at least that far to the left of the anchor are side 0, the others reach as far to the right.
    """
    more = (LENGTH - size + 1) // 2
    left = max(0, min(n, g - more + 1))
    return [(side, s, k, at) for side, s, k, at in ((0, 0, left, g - more), (1, left, n - left, g - left)) if k]


def _split(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for b in batches:
                for c, doc, th, start, n, g, piece in zip(b["c"], b["doc_id"].astype("Int64"), b["th"], b["start"], b["n"], b["g"], b["piece"]):
                    if g < 0:
                        g = int(window_anchors(np.frombuffer(piece, np.uint8)[:LENGTH], LENGTH, size)[0][0])
                    grown = size + (LENGTH - size + 1) // 2
                    for side, s, k, at in halves(piece, n, g, size):
                        part = piece[s : s + k + LENGTH - 1]
                        yield None, int(np.uint64(xxhash.xxh64_intdigest(part[at : at + grown], side)).view(np.int64)), c, doc, th, start + s, k, at, part

        return _frames(rows())

    return run


def _sharded(k: str = "bytes"):
    """Column: whether an anchor's contexts fit a shard."""
    return F.col(k) <= SHARD_BYTES


def _dealt_again(hot: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """Contexts that exceed their anchors' shards to (sharded contexts, marks of those that became equal)."""
    size, done, found, level = GRAM, None, [], 0
    while hot.limit(1).count():
        level, grown = level + 1, size + (LENGTH - size + 1) // 2
        sub = stage(hot.mapInPandas(_split(size), _PIECES).withColumn("ctx", F.xxhash64("piece")), "halves")
        kinds = sub.groupBy("anchor", "ctx").agg(F.sum("c").alias("c"), F.count("*").alias("rows"), F.min(F.struct("doc_id", "th", "start", "n", "g", "piece")).alias("rep"))
        kinds = stage(kinds, "kinds")
        twice = kinds.where("rows > 1").select("anchor", "ctx", F.col("rows").alias("m"))
        both = int(twice.agg(F.sum("m")).first()[0] or 0)
        found.append(attach(sub.where("c = 1"), ["anchor", "ctx"], twice, both, "m").select("doc_id", "th", "start", "n"))
        several = kinds.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(F.col("rep.n") + LENGTH).alias("bytes")).where("k > 1")
        several = stage(several, "several")
        row = several.agg(F.sum(F.when(_sharded(), F.col("bytes"))), F.sum("k")).first()
        shards = int((row[0] or 0) // SHARD_BYTES) + 1
        shard = F.when(_sharded(), -1 - F.pmod(F.xxhash64("anchor"), F.lit(shards)) * 16 - level).cast("int")
        need = attach(kinds, ["anchor"], several, int(row[1] or 0), "k").select(shard.alias("shard"), "anchor", "c", "rep.*")
        need = stage(need, "pieces")
        part = need.where("shard IS NOT NULL")
        done = part if done is None else done.unionByName(part)
        hot, size = need.where("shard IS NULL"), grown
    return done, found


def marks(docs: DataFrame) -> DataFrame:
    """Ranges of window starts (doc_id, th, start, n) whose windows also start elsewhere; ``docs`` has doc_id, th, text."""
    occ = stage(docs.where(F.octet_length("text") >= LENGTH).mapInPandas(_scan, _OCC), "contexts")
    local = occ.where("anchor IS NULL").select("doc_id", "th", "start", "n")
    occ = occ.where("anchor IS NOT NULL")
    kinds = occ.groupBy("anchor", "ctx").agg(F.sum("cnt").alias("c"), F.count("*").alias("rows"), F.min(F.struct("doc_id", "th", "start", "n")).alias("rep"))
    whole = occ.join(kinds.where("rows > 1").select("anchor", "ctx"), ["anchor", "ctx"], "left_semi").select("doc_id", "th", "start", "n")
    several = stage(kinds.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(F.col("rep.n") + LENGTH).alias("bytes")).where("k > 1"), "several")
    row = several.agg(F.sum(F.when(_sharded(), F.col("bytes"))), F.sum("k")).first()
    shards = int((row[0] or 0) // SHARD_BYTES) + 1
    need = attach(kinds, ["anchor"], several, int(row[1] or 0), "k")
    shard = F.when(_sharded(), F.pmod(F.xxhash64("anchor"), F.lit(shards))).cast("int")
    need = need.select("rep.doc_id", "rep.th", F.struct("anchor", "c", shard.alias("shard"), "rep.start", "rep.n").alias("w"))
    want = need.groupBy("doc_id", "th").agg(F.collect_list("w").alias("want")).withColumnsRenamed({"doc_id": "d2", "th": "t2"})
    asked = docs.join(want, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))).select("doc_id", "th", "text", "want")
    pieces = stage(asked.mapInPandas(_extract, _PIECES), "pieces")  # of repeated rows, each has the contexts; they count several times already
    again, found = _dealt_again(pieces.where("shard IS NULL"))
    pieces = pieces.where("shard IS NOT NULL")
    pieces = pieces if again is None else pieces.unionByName(again.select(*pieces.columns))
    out = local.unionByName(whole).unionByName(pieces.groupBy("shard").applyInPandas(_search, _MARK))
    for f in found:
        out = out.unionByName(f)
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc, text, ms in zip(b["doc_id"].astype("Int64"), b["text"], b["marks"]):
            data = (text or "").encode("utf-8", "replace")
            removed = spans = 0
            kept = data
            if ms is not None and len(ms):
                s, n = merge(np.array([m["start"] for m in ms], np.int64), np.array([m["n"] + LENGTH - 1 for m in ms], np.int64))
                removed, spans, parts, at = int(n.sum()), len(s), [], 0
                for x, y in zip(s.tolist(), n.tolist()):
                    parts.append(data[at:x])
                    at = x + y
                kept = b"".join([*parts, data[at:]])
            out.append((doc, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        f = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        yield f.astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every document with what is left of it: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    m = marks(rows).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("marks")).withColumnsRenamed({"doc_id": "d2", "th": "t2"})
    both = rows.join(m, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left").select("doc_id", "text", "marks")
    return both.mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op8_run_length_index": op8_run_length_index}
ORACLE: dict[str, str] = {}
