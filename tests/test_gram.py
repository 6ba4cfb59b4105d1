"""Correlations of all pairs from one scan."""

import random

import pytest
from pyspark.sql import functions as F

from creditloom.functions.expr import correlation
from creditloom.operators.woe import correlation_filter, correlation_pairs


def test_all_pairs_match_spark_and_read_once(spark):
    rng = random.Random(2)
    names = [f"x{i}" for i in range(12)]
    rows = []
    for _ in range(500):
        base = rng.gauss(0, 1)
        row = [1e9 + base * i + rng.gauss(0, 1) if rng.random() > 0.1 * (i % 4) else None for i in range(10)]
        rows.append((*row, 0.1, None))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    out = correlation_pairs(df, names)
    got = {(r["left"], r["right"]): r["corr"] for r in out.collect()}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    want = df.agg(*[correlation(F.col(a), F.col(b)) for a, b in pairs]).first()
    assert set(got) == set(pairs)
    for pair, w in zip(pairs, want):
        if "x10" in pair or "x11" in pair:
            assert got[pair] is None
        else:
            assert got[pair] == pytest.approx(w, abs=1e-6)


def test_many_columns_empty_frames_and_one_column(spark):
    wide = spark.range(60).select(*[((F.col("id") * (i + 1)) % 61).cast("double").alias(f"c{i}") for i in range(300)])
    assert correlation_pairs(wide, wide.columns).count() == 300 * 299 // 2
    assert correlation_pairs(wide, ["c0"]).count() == 0
    assert correlation_pairs(wide.limit(0), ["c0", "c1"]).count() == 0
    twice = wide.select("c0", (F.col("c0") * -2).alias("same"), F.lit(float("nan")).alias("none"))
    assert [(r.column, round(r.max_abs_corr, 9)) for r in correlation_filter(twice, twice.columns).collect()] == [("same", 1.0)]
