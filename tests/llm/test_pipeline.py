"""The stages in their order: columns, decisions, and each against its operator's brute force."""

from collections import Counter

import corpus_pipeline
from tests.llm.data import awkward, clashing, frame, words
from tests.oracle import SF_DIR
from tributary.llm import decontamination, mixing, quality, sharding, simhash
from tributary.llm.common import table


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    rows = out.collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert rows and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_quality_stage_keeps_good_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    kept = {r.doc_id for r in quality.quality_stage(spark, docs, SF_DIR).collect()}
    labels = table(spark, SF_DIR, "labels").collect()
    good, bad = [r.doc_id for r in labels if r.quality == 1], [r.doc_id for r in labels if r.quality == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)


def test_dedup_stage_leaves_one_of_each_group(spark):
    t = words(200, 5)
    rows = [(10, t, "en", "a", 1), (3, t, "en", "b", 1), (7, t.replace(" ", "  ", 1), "en", "c", 1), (3, t, "en", "b", 1), (8, words(200, 6), "en", "a", 1), (None, t, "en", "a", 1)]
    out = simhash.simhash_stage(spark, frame(spark, rows), SF_DIR)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "8"]


def test_dedup_stage_tells_rows_by_id_and_text(spark):
    rows = [(1, words(100, 1), "en", "a", 1), (1, words(100, 2), "en", "a", 1), (None, words(100, 3), "en", "a", 1), (None, words(100, 3), "en", "a", 1), (None, words(100, 4), "en", "a", 1)]
    out = simhash.simhash_stage(spark, frame(spark, rows), SF_DIR)
    assert sorted(r.text for r in out.collect()) == sorted(words(100, k) for k in (1, 2, 3, 4))


def test_decontamination_stage(spark):
    item = table(spark, SF_DIR, "benchmark").first().text
    out = decontamination.decontamination_stage(spark, frame(spark, [(1, f"a b {item} c", "en", "a", 1), (2, words(50, 1), "en", "a", 1), (None, item, "en", "a", 1)]), SF_DIR)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2"]


def test_mixing_stage_repeats_rows(spark):
    docs = frame(spark)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[str(r.doc_id)] += r.repeats if r.size else 1
    out = mixing.mixing_stage(spark, docs, SF_DIR)
    assert out.columns == docs.columns and Counter(str(r.doc_id) for r in out.collect()) == +want


def test_extra_columns_pass_through_the_stages(spark):
    docs = clashing(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == (docs.columns if name != "sharding" else [*docs.columns, "shard", "slot"])
        assert all((r.fp, r["size"], r.key, r.c, r.y, r.score, r.marks, r.bucket, r.p) == (1, 2, 3, "x", 4, 0.5, "m", "b", 9) for r in out.collect())


def test_rebalanced_shards_are_even(spark):
    out = sharding.sharding_stage(spark, table(spark, SF_DIR, "documents"), SF_DIR)
    size = Counter()
    for r in out.collect():
        size[r.shard] += len((r.text or "").encode()) + 1
    assert len(size) == 8 and max(size.values()) < 1.1 * sum(size.values()) / 8


def test_stages_on_awkward_and_empty_tables(spark):
    for rows in (awkward(), []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            assert out.count() <= 2 * len(rows)
    assert sharding.sharding_stage(spark, frame(spark), SF_DIR).count() == len(awkward())
