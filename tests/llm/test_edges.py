"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.data import awkward, clashing, empty, frame
from tributary.llm import decontamination, embeddings, mixing, quality, secrets, sharding, simhash, substrings, toxicity, urls

ITEMS = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def items(spark, rows=((1, "alpha beta gamma delta epsilon zeta"), (2, None), (None, ""), (1, "alpha beta gamma delta epsilon zeta"))):
    return spark.createDataFrame(list(rows), ITEMS)


def no_labels(spark):
    return spark.createDataFrame([], LABELS)


def sizes(rows, column):
    return sorted(str(getattr(r, column)) for r in rows)


def ratios(spark, _memo={}):
    if not _memo:
        _memo["r"] = secrets.train(secrets.labelled_samples(spark, 300))
    return _memo["r"]


#: name: (what one row per document is computed by, its doc_id column)
PER_DOCUMENT = {
    "secrets": lambda s, d: secrets.scan(d, ratios(s)),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, no_labels(s))),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "near_copies": lambda s, d: simhash.near_copies(d),
    "sharding": lambda s, d: sharding.assign_shards(d, sharding.initial_map(s, 3, 64), 1, 64),
    "quality": lambda s, d: quality.score(d, quality.train(d, no_labels(s))),
    "substrings": lambda s, d: substrings.remove_repeats(d),
    "mixing": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT))
def test_one_row_per_document(spark, name):
    f = PER_DOCUMENT[name]
    want = sorted(str(r[0]) for r in awkward())
    plain = f(spark, frame(spark)).collect()
    assert sizes(plain, "doc_id") == want
    assert sizes(f(spark, clashing(spark)).collect(), "doc_id") == want
    assert f(spark, empty(spark)).count() == 0


def test_defined_results(spark):
    d = frame(spark)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (None, 1), (7, 7), (8, 8)} <= got
    cut = {r.doc_id: r for r in substrings.remove_repeats(d).collect() if r.doc_id}
    assert cut[4].n_removed == cut[4].n_bytes > 0 and cut[5].kept_sha256 == hashlib.sha256(b"").hexdigest() and cut[1].n_bytes == 0 == cut[6].n_removed
    shard = [r for r in sharding.assign_shards(d, sharding.initial_map(spark, 3, 64), 1, 64).collect()]
    assert {r.size for r in shard if r.doc_id in (1, 2)} == {1} and all(r.text_crc32 == 0 for r in shard if r.doc_id in (1, 2))
    mixed = mixing.mix(d).collect()
    assert all(r.size == 0 for r in mixed if r.doc_id in (1, 2, 3)) and len({r.target for r in mixed if r.source is None}) == 1
    assert all(not r.base and not r.extra for r in secrets.scan(d, ratios(spark)).collect() if r.doc_id in (1, 2, 3))


def test_decontamination_edges(spark):
    d = frame(spark, [*awkward(), (9, "x alpha beta gamma delta epsilon zeta y", "en", "a", 1), (None, "alpha beta gamma delta epsilon zeta", None, None, None)])
    got = {(r.doc_id, r.item_id) for r in decontamination.find(d, items(spark)).collect()}
    assert got == {(9, 1), (None, 1)}
    assert decontamination.find(clashing(spark), items(spark)).count() == 0
    assert decontamination.find(empty(spark), items(spark)).count() == 0
    assert decontamination.find(d, items(spark, ())).count() == 0


def test_url_edges(spark):
    log = spark.createDataFrame([("Bad.example.com", "add", "2024-01-10"), ("bad.example.com", "remove", "2024-02-01"), ("bad.example.com", "add", "2024-02-01"), (None, "add", "2024-01-01"), ("x.org", "add", None)], "domain string, action string, day string")
    log = log.select("domain", "action", F.to_date("day").alias("effective"))
    rows = [(1, "http://a.BAD.example.com:80/x", "2024-01-10"), (2, "http://bad.example.com", "2024-01-09"), (3, "http://notbad.example.com", "2024-01-20"), (4, None, "2024-01-20"), (5, "no url", "2024-01-20"), (6, "http://bad.example.com", None), (7, "https://u@bad.example.com./", "2024-02-01"), (1, "http://a.BAD.example.com:80/x", "2024-01-10")]
    caps = spark.createDataFrame(rows, "page_id long, url string, day string").select("page_id", "url", F.to_date("day").alias("fetched"), F.lit(1).alias("domain"), F.lit(2).alias("m"))
    got = urls.evaluate(caps, log).collect()
    assert sorted((r.page_id, r.blocked) for r in got) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False)]
    assert urls.evaluate(caps, log.where("false")).where("blocked").count() == 0
    assert urls.evaluate(caps.where("false"), log).count() == 0


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, node long, m int, leaf string"
    rows = [(1, [1.0, 0.0], 1, 1, 1, "x"), (1, [1.0, 0.0], 1, 1, 1, "x"), (2, [2.0, 0.0], 1, 1, 1, "x"), (3, [1.0, 0.0, 0.0], 1, 1, 1, "x"), (None, [1.0, 0.0], 1, 1, 1, "x"), (None, None, None, None, None, None), (4, [], 1, 1, 1, "x")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == sorted([("1", 3, 1, True), ("1", 3, 1, True), ("2", 3, 1, False), ("3", 0, 3, True), ("None", 3, 1, False), ("None", 0, None, False), ("4", 0, 4, True)])
    assert embeddings.near_duplicates(df.where("false")).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id = 3")).count() == 1


def test_toxicity_and_quality_without_labels_keep_all(spark):
    d = frame(spark)
    assert all(r.score == 0.5 for r in toxicity.score(d, toxicity.train(d, no_labels(spark))).collect())
    assert all(r.score == 1.0 for r in quality.score(d, quality.train(d, no_labels(spark))).collect())
    nulls = spark.createDataFrame([(None, None, None), (4, None, None), (4, 1, 0)], LABELS)
    assert toxicity.score(d, toxicity.train(d, nulls)).count() == len(awkward()) == quality.score(d, quality.train(d, nulls)).count()
