"""The mergeable isotonic fit against the definition and another implementation."""

import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from creditloom.operators import calibrate as K


def brute(points):
    """Largest mean over lower starts of the smallest mean over higher ends; points are (score, total, n)."""
    out = []
    for i in range(len(points)):
        best = None
        for a in range(i + 1):
            low = min(sum(p[1] for p in points[a : b + 1]) / sum(p[2] for p in points[a : b + 1]) for b in range(i, len(points)))
            best = low if best is None else max(best, low)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_pooling_pooled_lists_is_pooling_the_points(seed):
    rng = random.Random(seed)
    points = [(float(i), float(rng.randrange(4)), float(rng.randrange(1, 5))) for i in range(60)]
    whole = K.pool((s, s, t, n) for s, t, n in points)
    fitted = [t / n for low, high, t, n in whole for s, _, _ in points if low <= s <= high]
    assert fitted == pytest.approx(brute(points))
    cuts = sorted(rng.sample(range(1, 60), 7))
    parts = [K.pool((s, s, t, n) for s, t, n in points[a:b]) for a, b in zip([0, *cuts], [*cuts, 60])]
    assert K.pool(b for part in parts for b in part) == whole


@pytest.mark.parametrize("shape", ["rising", "falling", "noise"])
def test_continuous_scores_match_spark_ml(spark, shape):
    rng = random.Random(7)
    chance = {"rising": lambda x: x, "falling": lambda x: 1 - x, "noise": lambda x: 0.3}[shape]
    rows = [(x, int(rng.random() < chance(x))) for x in (rng.random() for _ in range(4000))]
    rows += [(0.5, 1)] * 1500 + [(0.5, 0)] * 500 + [(None, 1), (0.2, None), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "p double, y int").repartition(6)
    fit = K.fit_isotonic(df, buckets=300)
    rates = [s[2] for s in fit.steps]
    assert rates == sorted(set(rates)) and all(a[1] < b[0] for a, b in zip(fit.steps, fit.steps[1:]))
    probe = spark.createDataFrame([(x,) for x in [-1.0, 0.0, 0.5, 2.0, *[rng.random() for _ in range(400)]]], "p double")
    clean = df.filter("p is not null and y is not null and not isnan(p)").select(F.col("p").alias("x"), F.col("y").cast("double").alias("l"))
    model = IsotonicRegression(featuresCol="x", labelCol="l", predictionCol="want").fit(clean)
    for r in model.transform(fit.apply(probe, "p", "got").withColumn("x", F.col("p"))).collect():
        assert r.got == pytest.approx(r.want, abs=1e-9) and fit.value(r.p) == pytest.approx(r.want, abs=1e-9)


def test_edges(spark):
    one = K.fit_isotonic(spark.createDataFrame([(0.4, 1), (0.4, 0), (0.4, 0)], "p double, y int"))
    assert one.steps == [(0.4, 0.4, 1 / 3)]
    got = one.apply(spark.createDataFrame([(0.1,), (0.4,), (None,)], "p double")).collect()
    assert [r.p for r in got] == [1 / 3, 1 / 3, None]
    with pytest.raises(ValueError, match="no rows"):
        K.fit_isotonic(spark.createDataFrame([], "p double, y int")).apply(spark.range(1).selectExpr("0.5D as p"))
