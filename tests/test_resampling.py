"""Resamples and shares of groups of any size."""

import hashlib
import statistics

import pytest
from pyspark.sql import functions as F

from memloom.operators import curation, metrics

STATISTICS = {"max": F.max, "mean": F.avg}


def resampled(values, group, size, resamples, seed=42):
    """Means of resamples, one draw at a time."""
    v, out = sorted(values), []
    for r in range(resamples):
        draws = []
        for j in range(size):
            text = "|".join(str(x) for x in (seed, group, r, j) if x is not None)
            draws.append(v[int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % len(v)])
        out.append((max(draws), sum(draws) / size))
    return out


def test_bootstrap_draws_one_by_one(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", 7.0), (None, 5.0), (None, 6.0), ("none", None), ("a", 1.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    for size in (None, 3):
        got = {(r.g, r.statistic): (r.mean, r.std) for r in metrics.bootstrap(df, group="g", value="value", statistics=STATISTICS, size=size, resamples=40).collect()}
        assert set(got) == {(g, s) for g in ("a", "b", None) for s in STATISTICS}
        for g in ("a", "b", None):
            own = [v for k, v in rows if k == g and v is not None]
            want = resampled(own, g, size or len(own), 40)
            for k, name in enumerate(STATISTICS):
                drawn = [x[k] for x in want]
                assert got[g, name] == pytest.approx((statistics.fmean(drawn), statistics.pstdev(drawn)))
        assert got["b", "max"] == (7.0, 0.0)


def test_bootstrap_does_not_hang_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("g"), (F.col("id") % 31).cast("double").alias("value"))
    run = lambda d: sorted(map(tuple, metrics.bootstrap(d, group="g", value="value", statistics=STATISTICS, resamples=10).collect()))
    assert run(df.repartition(1)) == run(df.repartition(5, "value"))


def test_bootstrap_of_a_hot_group(spark):
    n, tries = 30_000, 40
    df = spark.range(n + 20).select(F.when(F.col("id") < n, 0).otherwise(F.col("id")).alias("g"), (F.col("id") % 100).cast("double").alias("value"))
    out = metrics.bootstrap(df, group="g", value="value", statistics={"mean": F.avg, "n": F.count}, resamples=tries)
    got = {r.statistic: r for r in out.where("g = 0").collect()}
    # a mean of n draws has the values' own mean, and their deviation over the root of n
    spread = (sum((x - 49.5) ** 2 for x in range(100)) / 100 / n) ** 0.5
    assert got["mean"].mean == pytest.approx(49.5, abs=5 * spread / tries**0.5) and got["mean"].std == pytest.approx(spread, rel=0.5)
    assert (got["n"].mean, got["n"].std) == (n, 0.0)
    assert out.where("g > 0").count() == 40


def test_bootstrap_of_nothing(spark):
    df = spark.createDataFrame([], "g long, value double")
    assert metrics.bootstrap(df, group="g", value="value", statistics=STATISTICS, resamples=5).collect() == []
    assert metrics.bootstrap(df, group="g", value="value", statistics=STATISTICS, size=2, resamples=5).columns == ["g", "statistic", "mean", "std"]


def test_share_of_large_groups_only(spark):
    rows = [("big", k) for k in range(101)] + [("edge", k) for k in range(1000, 1050)] + [(None, k) for k in range(2000, 2060)] + [("small", 7)]
    df = spark.createDataFrame(rows, "g string, _rank long").repartition(3)
    got = curation.sample_share(df, 0.25, group="g", key="_rank")
    assert got.columns == ["g", "_rank"]
    kept = sorted(((r.g, r._rank) for r in got.collect()), key=repr)
    sizes = {g: sum(x == g for x, _ in kept) for g in ("big", "edge", None, "small")}
    assert sizes == {"big": 25, "edge": 50, None: 15, "small": 1}
    assert kept == sorted(((r.g, r._rank) for r in curation.sample_share(df.repartition(7), 0.25, group="g", key="_rank").collect()), key=repr)
    order = sorted(range(101), key=lambda k: hashlib.md5(f"share|{k}".encode()).hexdigest())
    assert [k for g, k in kept if g == "big"] == sorted(order[:25], key=lambda k: repr(("big", k)))
    assert curation.sample_share(df.limit(0), 0.5, group="g", key="_rank").count() == 0


@pytest.mark.parametrize("size", [None, 3])
def test_bootstrap_of_arrays_and_of_joins_is_the_same(spark, size):
    rows = [(g, float(k * 7 % 11) if k % 5 else None) for g, n in ((1, 40), (2, 9), (None, 30), (3, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g long, value double").repartition(3)
    run = lambda whole: {(r.g, r.statistic): (r.mean, r.std) for r in metrics.bootstrap(df, group="g", value="value", statistics=STATISTICS, size=size, resamples=20, whole=whole).collect()}
    arrays = run(100)
    for whole in (0, 10):
        joins = run(whole)
        assert set(joins) == set(arrays) and all(joins[k] == pytest.approx(arrays[k]) for k in arrays)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_draws_of_small_groups_are_not_shuffled(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("g"), F.col("id").cast("double").alias("value"))
    out = metrics.bootstrap(df, group="g", value="value", statistics=STATISTICS, size=8, resamples=20)
    # the values by group, and nothing after them
    assert shuffles(out) <= 1 and "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_samples(spark, monkeypatch):
    from memloom.plans import metrics_queries

    monkeypatch.setattr(metrics_queries, "SAMPLES_A_TASK", 100)
    out = metrics_queries.samples(spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() > 50
    best = metrics.best_worst_at_n(out, source="source", prompt="uid", value="reward")
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Window") == 1
