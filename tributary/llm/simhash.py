"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into ``SEGMENTS`` consecutive segments on a ring. If two fingerprints differ in at most
``BITS`` bits, some chain of consecutive segments stays within its proportional budget at every length: the
first l segments differ in at most l * BITS / SEGMENTS bits (the strong pigeonhole form on a ring). With 5
segments and 2 bits the first two segments of that chain are equal, which is the key candidates are joined
on, and longer prefixes of the chain prune candidates before the full Hamming check.

Equal fingerprints are one row from the start, so copies cost nothing. The members of a bucket (one key) are
compared inside tasks, by blocks of bounded size, and only a star of each component leaves a task, never pairs. Buckets of
several blocks are finished in a second round, after the first one's components are known: only members of
different components are compared there, so a bucket that is one large group costs rows, not pairs of blocks.

Defined results: a null, empty or blank text has fingerprint zero, which links like any other; a null doc_id
takes part but is never a component id (the id is null if no member has one); repeated rows give repeated
rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, by_block, fresh, maybe_broadcast, stage, table
from .components import connected_components

SHINGLE, SEED, BITS, SEGMENTS = 3, 42, 2, 5
#: A bucket (key of chain or sample i) and the two blocks of it that are compared.
PAIR = ("i", "key", "x", "y")
#: Members of a bucket that are compared in one block.
BLOCK = 4096
_CHUNK = 1 << 15  # shingles whose bits are unpacked at once


def shingle_hashes(text: str | None, k: int = SHINGLE) -> list[int]:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z changes, only ASCII space splits
    if not words:
        return []
    if len(words) < k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    h, join = xxhash.xxh64_intdigest, b" ".join
    return [h(join(g), SEED) for g in zip(*(words[i:] for i in range(k)))]


def fingerprints(texts, k: int = SHINGLE) -> np.ndarray:
    """SimHash of each text as uint64: a bit is set if it is set in over half the shingle hashes."""
    return np.array([_simhash(shingle_hashes(t, k)) for t in texts], np.uint64)


def _simhash(hashes: list[int]) -> int:
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, ">u8")
    for at in range(0, len(values), _CHUNK):
        ones += np.unpackbits(values[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fingerprints(b["text"].tolist()).view(np.int64)})


def segment_bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment; widths differ by one at most."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(i: int, n: int, segments: int = SEGMENTS) -> int:
    """Signed 64-bit mask of the chain of ``n`` segments that starts at segment ``i`` of the ring."""
    bounds, m = segment_bounds(segments), 0
    for j in range(i, i + n):
        low, width = bounds[j % segments]
        m |= ((1 << width) - 1) << low
    return m - (1 << 64) if m >> 63 else m


def chain_key_length(bits: int = BITS, segments: int = SEGMENTS) -> int:
    """How many segments at the head of a chain must be equal: the longest l with l * bits / segments < 1."""
    return max(n for n in range(1, segments + 1) if n * bits // segments == 0)


def _join(root: np.ndarray, lo: int, hi: int, x: int, y: int) -> None:
    """Give the components of rows ``x`` and ``y`` one label among rows lo to hi."""
    p, q = root[x], root[y]
    if p != q:
        own = root[lo:hi]
        own[own == max(p, q)] = min(p, q)


def _star(ids: np.ndarray, comp: np.ndarray, root: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
    """Links (a, b) of each block from the least id of every new component to one member of each that it joined."""
    block = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    f = pd.DataFrame({"block": block, "root": root[: len(block)], "comp": comp[: len(block)], "id": ids[: len(block)]})
    f = f[f["root"].ne(f["comp"]) | f.duplicated(["block", "root"], keep=False)].groupby(["block", "root", "comp"], sort=False)["id"].min().reset_index()
    f["a"] = f.groupby(["block", "root"])["id"].transform("min")
    return f.loc[f["a"] != f["id"], ["a", "id"]].rename(columns={"id": "b"}).drop_duplicates()


def _ring(bits: int, segments: int):
    """Of rows (i, key, x, y, id, comp), sorted by the first four: a star of each component within each block."""
    first = chain_key_length(bits, segments)
    masks = np.array([[_mask(s, n, segments) for s in range(segments)] for n in range(first + 1, segments + 1)], np.int64).view(np.uint64)
    budgets = [n * bits // segments for n in range(first + 1, segments + 1)]

    def run(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        fp, chain = rows["id"].to_numpy(np.int64).view(np.uint64), rows["i"].to_numpy(np.int64)
        size = np.diff(cuts)
        end = np.repeat(cuts[1:], size)
        begin = np.repeat(cuts[:-1], size)
        _, comp = np.unique(rows["comp"].to_numpy(np.int64), return_inverse=True)
        root = comp.copy()
        at, d = np.flatnonzero(np.arange(len(fp)) + 1 < end), 1
        while len(at):
            a = at[root[at] != root[at + d]]
            for mask, budget in zip(masks, budgets):  # prefixes of the chain; the last one is the whole ring
                a = a[np.bitwise_count((fp[a] ^ fp[a + d]) & mask[chain[a]]) <= budget]
            for x in a.tolist():
                _join(root, begin[x], end[x], x, x + d)
            d += 1
            at = at[at + d < end[at]]
        return _star(fp.view(np.int64), comp, root, cuts)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*PAIR).sortWithinPartitions(*PAIR)


def _home(block: int, salt: int, n: str = "n") -> tuple[Column, Column]:
    """How many blocks a bucket of ``n`` rows has, and which one a row belongs to."""
    g = F.greatest(F.lit(1), F.ceil(F.expr(n) / F.lit(block))).cast("int")
    return g, F.pmod(F.xxhash64(F.lit(salt), "id"), g).cast("int")


def _open_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (i, key, id, comp, weight, ...) of buckets with several components, in pairs of blocks (x, y).

    Every two members of different components meet: one of them at least is not of the bucket's commonest component.
    So members of that one go to a block each and meet the blocks of the others; these meet each other as well.
    """
    by = rows.groupBy("i", "key", "comp").agg(F.sum("weight").alias("w"), F.count("*").alias("m"))
    open_ = by.groupBy("i", "key").agg(F.max_by("comp", F.struct("w", "comp")).alias("major"), F.sum("w").alias("all"), F.max("w").alias("most"), F.sum("m").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    total = int(open_.agg(F.sum("n")).first()[0] or 0)
    rows = attach(rows, ["i", "key"], open_.withColumn("rest", F.col("all") - F.col("most")), total)
    (gm, hm), (gn, hn) = _home(block, 11, "most"), _home(block, 12, "rest")
    each = lambda g: F.sequence(F.lit(0), g - 1)
    pair = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    major = F.transform(each(gn), lambda j: pair(j, gn + hm))
    other = F.concat(F.transform(each(gn), lambda j: pair(F.least(hn, j), F.greatest(hn, j))), F.transform(each(gm), lambda j: pair(hn, gn + j)))
    at = F.when(F.col("all") <= block, F.array(pair(F.lit(0), F.lit(0)))).when(F.col("comp") == F.col("major"), major).otherwise(other)
    keep = [c for c in rows.columns if c not in ("major", "all", "most", "n", "kinds", "rest")]
    return rows.select(*keep, F.explode(at).alias("at")).select(*keep, "at.x", "at.y")


def _with_components(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def links(fps: DataFrame, bits: int = BITS, segments: int = SEGMENTS, block: int | None = None) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fps`` (fp) that connect exactly what links of at most ``bits`` bits connect.

    In each bucket, the least fingerprint of a component is paired with the others.
    """
    block, n = block or BLOCK, chain_key_length(bits, segments)
    masks = [_mask(i, n, segments) for i in range(segments)]
    keyed = fps.select(F.col("fp").alias("id"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("i", "key"))
    large = stage(keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where(F.col("n") > block), "large")
    several = large.limit(1).count() > 0
    if several:
        rows = keyed.join(maybe_broadcast(large), ["i", "key"], "left").withColumn("x", _home(block, 11, "coalesce(n, 1)")[1])
    else:
        rows = keyed.withColumn("x", F.lit(0))
    ring = by_block(_ring(bits, segments), *PAIR)
    found = stage(_dealt(rows.select("i", "key", "x", F.lit(0).alias("y"), "id", F.col("id").alias("comp"))).mapInPandas(ring, "a long, b long").distinct(), "links")
    if several:
        large = keyed.join(maybe_broadcast(large.drop("n")), ["i", "key"])
        rows = _with_components(large.select("i", "key", "id", F.lit(1).alias("weight")), connected_components(found))
        more = _dealt(_open_blocks(rows, block).select("i", "key", "x", "y", "id", "comp")).mapInPandas(ring, "a long, b long")
        found = found.unionByName(stage(more.distinct(), "links"))
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id reachable: (doc_id, fp, component_id)."""
    marks = stage(docs.select("doc_id", "text").mapInPandas(_scan, "doc_id long, fp long"), "simhash")
    groups = marks.groupBy("fp").agg(F.min("doc_id").alias("low"))
    ids = _least(groups.withColumnRenamed("fp", "id"), links(groups.select("fp")))
    return marks.join(ids.select(F.col("id").alias("fp"), F.col("low").alias("component_id")), "fp")


def _least(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` (id, low) with the least ``low`` of all groups that ``edges`` (a, b) connect: (id, low)."""
    named = stage(_with_components(groups, connected_components(edges)), "groups")
    least = named.groupBy("comp").agg(F.min("low").alias("low"), F.count("*").alias("n"))
    several = named.where("id <> comp").select("comp").distinct()  # most components are one group
    alone = named.join(several, "comp", "left_anti").select("id", "low")
    linked = named.join(several, "comp", "left_semi").select("id", "comp")
    least = least.where("n > 1")
    return alone.unionByName(attach(linked, ["comp"], least, int(least.agg(F.sum("n")).first()[0] or 0)).select("id", "low"))


#: Near copies: words per shingle and similarity; samples per document, shingles per sample.
COPY_SHINGLE, COPY_SIMILARITY, SAMPLES, SAMPLE_SIZE = 5, 0.8, 16, 3
#: Least hashes in a sketch of a text's distinct shingles, and how many must agree for the texts to be compared: at similarity
#: 0.8 fewer do with a chance of one in a million.
SKETCH, AGREE = 64, 34
#: Shingles of the texts in one block of the second round; so many that a block has at most ``BLOCK`` texts.
BLOCK_SHINGLES = 1 << 20
_SPREAD = np.random.default_rng(4).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SKETCH = np.random.default_rng(5).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: list[int]) -> bytes:
    """``SKETCH`` min-hashes of a text's distinct shingles, 16 bits each; repeats do not count, as in ``similarity``."""
    h = np.unique(np.array(hashes, np.uint64))
    if not len(h):
        return bytes(2 * SKETCH)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        x = h[at : at + 1024, None] * _SKETCH
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=0))
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16).tobytes()


def sample_fingerprints(hashes: list[int]) -> np.ndarray:
    """SimHash of each of ``SAMPLES`` samples of a text's shingles: the ``SAMPLE_SIZE`` that a seeded hash ranks first."""
    if not hashes:
        return np.zeros(SAMPLES, np.int64)
    h = np.unique(np.array(hashes, np.uint64))
    out = np.empty(SAMPLES, np.uint64)
    for t, m in enumerate(_SPREAD):
        rank = h * m
        rank ^= rank >> np.uint64(31)
        first = h[np.argpartition(rank, SAMPLE_SIZE - 1)[:SAMPLE_SIZE]] if len(h) > SAMPLE_SIZE else h
        a, b, c = first[0], first[min(1, len(first) - 1)], first[-1]
        out[t] = (a & b) | (a & c) | (b & c)
    return out.view(np.int64)


def set_id(hashes: list[int]) -> int:
    """A hash of a text's distinct shingles: texts of similarity 1 have the same. Zero without shingles."""
    return int(np.array(xxhash.xxh64_intdigest(np.unique(np.array(hashes, np.uint64)).tobytes(), SEED), np.uint64).view(np.int64)) if hashes else 0


def _scan_copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def row(text) -> tuple:
        x = shingle_hashes(text, COPY_SHINGLE)  # of one text at a time
        return _simhash(x), set_id(x), sample_fingerprints(x), sketch(x)

    for b in batches:
        fp, sid, samples, sketches = zip(*[row(t) for t in b["text"]]) if len(b) else ((),) * 4
        yield pd.DataFrame({
            "doc_id": b["doc_id"].astype("Int64"), "th": b["th"], "fp": np.array(fp, np.uint64).view(np.int64), "sid": np.array(sid, np.int64),
            "samples": list(samples), "sketch": list(sketches),
        })


def similarity(a: set, b: set) -> float:
    return len(a & b) / max(1, len(a | b)) if a or b else 1.0


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, grams, weight): 32 bits of the hash of each distinct shingle, packed (two texts of 10,000 shingles agree in 0.02 by chance)."""
    for b in batches:
        grams = [np.unique((np.array(shingle_hashes(t, COPY_SHINGLE), np.uint64) >> np.uint64(32)).astype(np.uint32)) for t in b["text"]]
        yield pd.DataFrame({"id": b["id"], "grams": [g.tobytes() for g in grams], "weight": np.array([max(BLOCK_SHINGLES // BLOCK, len(g)) for g in grams], np.int64)})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        a, b = ([np.frombuffer(g, np.uint32) for g in batch[c]] for c in ("ga", "gb"))
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)]
        ok = [n / max(1, len(x) + len(y) - n) >= COPY_SIMILARITY for n, x, y in zip(both, a, b)]
        yield batch.loc[ok, ["a", "b"]]


def _likely(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
    """Pairs (a, b) of each block that the shingles should decide: every member with its likeliest partner by the sketches.

    (a, a) says that a member has likely partners besides, or that its bucket has other blocks.
    """
    sid, many = rows["id"].to_numpy(np.int64), rows["many"].to_numpy(bool)
    sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(-1, SKETCH)
    out: set[tuple[int, int]] = set()
    for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
        own, marks = sid[lo:hi], np.ascontiguousarray(sketches[lo:hi].T)
        if many[lo]:
            out.update(zip(own.tolist(), own.tolist()))
        step = max(1, (1 << 21) // (hi - lo))
        for at in range(0, hi - lo, step) if hi - lo > 1 else ():
            top = min(at + step, hi - lo)
            near = np.zeros((top - at, hi - lo), np.int8)
            for t in range(SKETCH):
                near += marks[t, at:top, None] == marks[t]
            near[np.arange(top - at), np.arange(at, top)] = 0
            best, others = near.argmax(axis=1), (near >= AGREE).sum(axis=1)
            for r in np.flatnonzero(others).tolist():
                x, y = int(own[at + r]), int(own[best[r]])
                out.add((min(x, y), max(x, y)))
                if others[r] > 1:
                    out.add((x, x))
    return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")


def _exact(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
    """A star of each component of similar shingle sets in a block, by counting the common shingles of all its pairs at once."""
    _, comp = np.unique(rows["comp"].to_numpy(np.int64), return_inverse=True)
    root = comp.copy()
    for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
        sets = [np.frombuffer(g, np.uint32) for g in rows["grams"].iloc[lo:hi]]
        size, m = np.array([len(g) for g in sets]), hi - lo
        if m < 2 or (root[lo:hi] == root[lo]).all():
            continue
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(m), size), (count > 1)[column]
        row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common, width = np.zeros((m, m), np.float32), 2048
        edges = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 1 + width, width))
        for k, (s, e) in enumerate(zip(edges, edges[1:])):
            x = np.zeros((m, width), np.float32)
            x[row[s:e], column[s:e] - k * width] = 1
            common += x @ x.T
        for r in range(m - 1):
            n = common[r, r + 1 :].astype(np.float64)
            hit = np.flatnonzero((n / np.maximum(1, size[r] + size[r + 1 :] - n) >= COPY_SIMILARITY) & (root[lo + r] != root[lo + r + 1 : hi])) + r + 1 + lo
            for y in hit.tolist():
                _join(root, lo, hi, lo + r, y)
    return _star(rows["id"].to_numpy(np.int64), comp, root, cuts)


def near_copies(docs: DataFrame, block: int | None = None) -> DataFrame:
    """Every row of ``docs`` with the least row of its group of near copies: (doc_id, th, fp, component_id, low).

    ``th`` is a hash of the text, ``low`` the struct (missing, doc_id, th) of the least row; a missing id comes last.
    Near copies share ``COPY_SIMILARITY`` of their distinct five-word shingles; texts with the same shingles are one row
    from the start. Fingerprints of near copies may differ in more bits than a segment key survives, so fingerprints of
    samples name candidates besides the pigeonring links of whole texts, and the shingle sets decide; equal fingerprints
    alone join nothing. Near copies agree in some of the ``SAMPLES`` samples: at similarity 0.8 all differ with a chance
    below one in ten thousand. In the first round every member of a bucket is compared with its likeliest partner there.
    Members with further likely partners go to the second, where all of a bucket's that are not yet of one component are
    compared inside tasks, in blocks of bounded size that return stars. So no pair of a bucket is left out, and rows
    follow the members, not the pairs.
    """
    block = block or BLOCK
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    marks = stage(rows.mapInPandas(_scan_copies, "doc_id long, th long, fp long, sid long, samples array<long>, sketch binary"), "simhash-copies")
    row = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("th"))
    groups = stage(marks.groupBy(F.col("sid").alias("id")).agg(F.min(row).alias("low"), F.min("sketch").alias("sketch")), "groups")
    fps = marks.select("fp", F.col("sid").alias("id")).distinct()
    near = links(fps.select("fp").distinct())
    ends = near.select(F.col("a").alias("key"), F.explode(F.array("a", "b")).alias("fp")).unionByName(fps.select(F.col("fp").alias("key"), "fp")).distinct()
    keyed = marks.select(F.col("sid").alias("id"), F.posexplode("samples").alias("i", "key")).unionByName(ends.join(fps, "fp").select("id", F.lit(-1).alias("i"), "key")).distinct()
    sizes = keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = stage(attach(keyed, ["i", "key"], sizes, (SAMPLES + 1) * groups.count()), "buckets")
    first = keyed.join(groups.select("id", "sketch"), "id").withColumns({"x": _home(block, 11)[1], "y": F.lit(0), "many": F.col("n") > block})
    found = stage(_dealt(first.select("i", "key", "x", "y", "id", "many", "sketch")).mapInPandas(by_block(_likely, *PAIR), "a long, b long").distinct(), "pairs")

    def grams(ids: DataFrame, name: str) -> DataFrame:
        """(id, grams, weight) of the groups ``ids``, read from the texts of their least rows."""
        at = groups.select("id", F.col("low.doc_id").alias("d2"), F.col("low.th").alias("t2")).join(ids, "id")
        at = maybe_broadcast(at)
        texts = rows.join(at, rows.doc_id.eqNullSafe(at.d2) & (rows.th == at.t2)).select("id", "text")
        return stage(texts.dropDuplicates(["id"]).mapInPandas(_sets, "id long, grams binary, weight long"), name)

    pairs, left = found.where("a < b"), found.where("a = b").select(F.col("a").alias("id"))
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(left).distinct()
    sets = grams(ends, "grams")
    sided = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    edges = stage(sided.select("a", "b", "ga", "gb").mapInPandas(_verify, "a long, b long"), "sure")
    if left.limit(1).count():
        rest = keyed.select("i", "key", "id").join(left, "id").join(sets.select("id", "weight"), "id")
        rest = stage(_open_blocks(_with_components(rest, connected_components(edges)), BLOCK_SHINGLES), "open")
        rest = rest.join(sets.select("id", "grams"), "id").select("i", "key", "x", "y", "id", "comp", "grams")
        edges = edges.unionByName(stage(_dealt(rest).mapInPandas(by_block(_exact, *PAIR), "a long, b long").distinct(), "sure"))
    least = _least(groups.select("id", "low"), edges)
    return marks.select("doc_id", "th", "fp", F.col("sid").alias("id")).join(least, "id").select("doc_id", "th", "fp", F.when(~F.col("low.missing"), F.col("low.doc_id")).alias("component_id"), "low")


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the row with the smallest doc_id (a missing one comes last).

    Different texts under one id are different rows; of rows equal in id and text one stays. Extra columns stay.
    """
    doc, th, own = fresh(docs, "_doc", "_th", "_own")
    found = near_copies(docs).groupBy("doc_id", "th").agg(F.min("low").alias("low"), F.count("*").alias("n"))
    first = (F.col("low.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("low.th") == F.col("th"))
    found = stage(found.select(F.col("doc_id").alias(doc), F.col("th").alias(th), first.alias(own), "n").where(F.col(th).isNotNull() & (~F.col(own) | (F.col("n") > 1))), "dropped")
    same = docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(th))
    kept = docs.join(maybe_broadcast(found.select(doc, th)), same, "left_anti")
    twice = found.where(own).select(doc, th)
    if not twice.limit(1).count():
        return kept
    one = docs.join(twice, same).dropDuplicates([doc, th]).drop(doc, th)
    return kept.unionByName(one)


QUERIES = {"op4_simhash_pigeonring": op4_simhash_pigeonring}
ORACLE: dict[str, str] = {}
