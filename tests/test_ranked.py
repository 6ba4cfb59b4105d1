"""Ordered statistics against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.plans import ranked as R


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols)).repartition(3)


@pytest.mark.parametrize("shape", ["normal", "ties", "hot", "constant", "negative"])
def test_bracketed_quantiles_equal_numpy(spark, shape):
    rng = np.random.default_rng(1)
    x = {
        "normal": rng.normal(size=3001),
        "ties": rng.integers(0, 7, 2000).astype(float),
        "hot": np.where(rng.random(3000) < 0.4, 5.0, rng.normal(size=3000)),
        "constant": np.full(50, 2.5),
        "negative": -np.abs(rng.normal(size=777)) * 1e6,
    }[shape]
    probs = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    df = frame(spark, x=x)
    for small in (0, R.SMALL_VALUES):
        got = R.quantile_map(df, ["x"], probs, small=small)["x"]
        assert got == pytest.approx(np.quantile(x, probs), rel=1e-12, abs=1e-12)


def test_quantiles_skip_nulls_and_leave_out_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    for small in (0, R.SMALL_VALUES):
        assert R.quantile_map(df, ["a", "b"], [0.5], small=small) == {"a": [2.0]}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.integers(2, 20))
def test_counts_below_do_not_depend_on_the_buckets(spark, values, buckets):
    df = frame(spark, x=np.array(values, dtype=float))
    rows = R.value_table(df, ["x"], buckets=buckets).collect()
    assert sum(r["n"] for r in rows) == len(values)
    for r in rows:
        assert r["below"] == sum(v < r["value"] for v in values)
        assert r["total"] == len(values)


def test_rows_at_breaks_ties_inside_a_heavy_key(spark):
    rng = np.random.default_rng(2)
    key = np.where(rng.random(500) < 0.5, 10.0, rng.integers(0, 20, 500))
    tie = rng.permutation(500).astype(float)
    order = sorted(zip(key, tie))
    positions = [0, 1, 120, 250, 251, 499]
    got = R.rows_at(frame(spark, k=key, t=tie), "k", "t", positions, 500)
    assert got == [order[p] for p in positions]


def test_value_table_keeps_groups_apart(spark):
    df = frame(spark, g=["a", "a", "b", "b", "b"], x=[1.0, 2.0, 2.0, 1.0, 1.0], y=[0, 1, 0, 1, 1])
    rows = {(r["g"], r["value"]): r for r in R.value_table(df, ["x"], "y", ["g"]).collect()}
    assert rows["b", 1.0]["n"] == 2 and rows["b", 1.0]["pos"] == 2
    assert rows["b", 2.0]["below"] == 2 and rows["b", 2.0]["pos_below"] == 2
    assert rows["a", 2.0]["below"] == 1 and rows["a", 2.0]["pos_total"] == 1


def test_order_statistics_fall_back_when_a_bracket_misses(spark, monkeypatch):
    monkeypatch.setattr(R, "MARGIN", -0.2)
    x = np.arange(100, dtype=float)
    assert R.order_statistics(frame(spark, x=x), [("x", 0.5, lambda n: [50, 51])]) == [[50.0, 51.0]]


def test_average_rank_matches_pandas(spark):
    x = [3.0, 1.0, 3.0, 2.0, 3.0]
    t = R.value_table(frame(spark, x=x), ["x"]).select("value", R.average_rank().alias("r"))
    want = dict(zip(x, pd.Series(x).rank()))
    assert {r["value"]: r["r"] for r in t.collect()} == want
    assert t.filter(F.col("r") > 4).count() == 0
