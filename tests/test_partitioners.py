import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import metrics, partitioners
from tributary.operators.sketches import ExactCardinality, HipCardinality


def keys(n=3000, distinct=200, seed=3):
    rnd = random.Random(seed)
    return [min(int(rnd.paretovariate(0.7)), distinct) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(partitioners.STRATEGIES))
def test_fold_keeps_to_its_choices(name):
    fold, where = partitioners.Fold(name, 16), {}
    for k in keys():
        where.setdefault(k, set()).add(fold.next(k))
    most = 1 if partitioners.single_choice(name) else fold.choices
    assert max(map(len, where.values())) <= most
    assert sum(fold.counts) == 3000


def test_two_choices_balance_better_than_hashing():
    fold, plain = partitioners.Fold("m-pk", 8), [0] * 8
    for k in keys():
        fold.next(k)
        plain[partitioners.folded(partitioners.key_bytes(k), 313) % 8] += 1
    assert max(fold.counts) < max(plain)


def test_ties_go_to_the_second_choice():
    fold = partitioners.Fold("pk", 1 << 16)
    _, (a, b) = fold.candidates("k")
    assert a != b and fold.next("k") == b and fold.next("k") == a


@pytest.mark.parametrize("kind", [ExactCardinality, HipCardinality])
def test_what_if_agrees_with_insert(kind):
    rnd, sketch = random.Random(5), kind()
    for _ in range(3000):
        code = rnd.getrandbits(64)
        asked = sketch.what_if(code)
        twin = sketch.copy()
        sketch.insert(code)
        assert sketch.count() == asked
        twin.insert(code)
        assert twin.count() == asked
    assert abs(sketch.count() - 3000) <= 150


def test_scopes_fold_alone_and_names_are_checked(spark):
    df = spark.range(400).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("k"), (F.col("id") % 2).alias("src"))
    got = partitioners.assign(df, "cn", 4, "k", "seq", ("src",)).collect()
    for s in (0, 1):
        fold = partitioners.Fold("cn", 4)
        for r in sorted((r for r in got if r.src == s), key=lambda r: r.seq):
            assert r.task == fold.next(r.k)
    with pytest.raises(ValueError):
        partitioners.assign(df, "none", 4, "k", "seq")


def test_loads_count_empty_tasks(spark):
    df = spark.range(10).select(F.lit(0).alias("task"), (F.col("id") % 3).alias("k"))
    row = metrics.imbalance(metrics.task_loads(df, 5, "k")).first()
    assert (row.tuples_imbalance, row.max_tuples, row.min_tuples, row.keys_imbalance) == (8.0, 10, 0, 2.4)
    assert metrics.replicated(df, "k").count() == 0


def test_windowed_strategy_forgets(spark):
    fold = partitioners.WindowedFold(8, 100, 10)
    for t in range(500):
        fold.next(t, t)
        assert sum(map(len, fold.live)) <= 111
    df = spark.range(60).select(F.col("id").alias("t"), (F.col("id") % 9).alias("k"))
    got, fold = {r.t: r.task for r in partitioners.assign_windowed(df, 4, "k", "t", 20, 5).collect()}, partitioners.WindowedFold(4, 20, 5)
    assert all(got[t] == fold.next(t, t % 9) for t in range(60))


def test_state_carries_over(spark):
    a = spark.range(30).select(F.col("id").alias("seq"), (F.col("id") % 5).alias("k"))
    first, second = partitioners.assign_after(a, a, "an", 8, "k", "seq")
    where = {r.k: r.task for r in first.collect()}
    assert second.count() == 30 and all(where[r.k] == r.task for r in second.collect())


def test_murmur_task_and_latencies(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.col("id").alias("seq"), (F.col("id") % 2).alias("w"))
    got = df.select("k", partitioners.murmur_task("k", F.lit(16), F.lit(313)).alias("t")).collect()
    assert all(r.t == partitioners.folded(partitioners.key_bytes(r.k), 313) % 16 for r in got)
    measured = partitioners.latencies(df, "cn", 8, "k", "seq", "w")
    assert [r.tuples for r in measured.collect()] == [25, 25]
    assert partitioners.latency_report(measured).first().windows == 1


def test_latency_report(spark):
    rows = spark.createDataFrame([(w, 1, float(w)) for w in range(1, 12)], "w long, tuples long, ms double")
    got = partitioners.latency_report(rows).first()
    assert (got.windows, got.mean, got.median, got.p90, got.p99) == (10, 5.5, 6.5, 10.0, 10.0)
    assert partitioners.latency_report(rows, closed=False).first().windows == 11
