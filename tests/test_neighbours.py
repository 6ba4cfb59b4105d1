"""Nearest-neighbour mutual information against all pairs of rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from creditloom.operators import neighbours
from creditloom.operators.neighbours import digamma, neighbour_information


def harmonic(n):
    return sum(1 / i for i in range(1, n))


def by_all_pairs(rows, k):
    rows = [(y, 0.0 if v is None or not math.isfinite(v) else float(v)) for y, v in rows if y is not None]
    size = {y: sum(1 for z, _ in rows if z == y) for y, _ in rows}
    rows = [r for r in rows if size[r[0]] > 1]
    terms = []
    for i, (y, v) in enumerate(rows):
        own = min(k, size[y] - 1)
        r = sorted(abs(u - v) for j, (z, u) in enumerate(rows) if z == y and j != i)[own - 1]
        m = sum(1 for _, u in rows if (u == v if r == 0 else v - r < u < v + r))
        terms.append(harmonic(own) - harmonic(size[y]) - harmonic(m))
    return max(0.0, harmonic(len(rows)) + sum(terms) / len(rows))


def tables():
    rng = random.Random(7)
    normal = [(i % 3 == 0, rng.gauss(2.0 * (i % 3 == 0), 1)) for i in range(300)]
    yield 3, 40, [(int(y), v) for y, v in normal]
    # Ties in few buckets, so that neighbours come from halos.
    yield 1, 2, [(rng.randrange(2), float(rng.randrange(12))) for _ in range(300)]
    yield 5, 7, [(rng.randrange(3), 5.0 if rng.random() < 0.5 else rng.random() * 10) for _ in range(300)]
    odd = [(1, None), (None, 3.0), (0, float("nan")), (1, float("inf")), (2, 9.0), (0, -4.0), (1, 2.0), (3, 1.0), (3, 1.5)]
    yield 3, 5, odd
    yield 3, 2, [(i % 2, 1.0) for i in range(20)]


@pytest.mark.parametrize("k, buckets, rows", list(tables()), ids=["shifted", "ties", "half-one-value", "nulls", "equal"])
def test_matches_all_pairs(spark, k, buckets, rows):
    df = spark.createDataFrame(rows, "y int, value double").repartition(3)
    got = neighbour_information(df, ["value"], "y", k, buckets).collect()
    assert [r.feature for r in got] == ["value"]
    assert got[0].mutual_info == pytest.approx(by_all_pairs(rows, k), abs=1e-9)


def test_digamma(spark):
    got = spark.range(1, 3000).select("id", digamma(F.col("id")).alias("d")).collect()
    euler = 0.5772156649015329
    assert all(r.d == pytest.approx(harmonic(r.id) - euler, abs=1e-12) for r in got[::37] + got[:5])


def test_empty(spark):
    assert neighbour_information(spark.createDataFrame([], "y int, value double"), ["value"], "y").count() == 0


def test_a_class_is_not_worked_on_in_one_task(spark, monkeypatch):
    inner, most = neighbours._distances, []

    def counted(values, k):
        # The windows run where the values lie: any set of their keys is a fair deal to Spark.
        dealt = values.groupBy("feature", "y", F.spark_partition_id().alias("task")).count().groupBy("feature", "y")
        most.extend(r.most / r.all for r in dealt.agg(F.max("count").alias("most"), F.sum("count").alias("all")).collect())
        return inner(values, k)

    monkeypatch.setattr(neighbours, "_distances", counted)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rng = random.Random(11)
        rows = [(i % 2, rng.gauss(0, 1)) for i in range(2000)]
        neighbour_information(spark.createDataFrame(rows, "y int, value double"), ["value"], "y", 3, 64).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(most) == 2
    assert max(most) < 0.6
