"""Sliced windows give the plain window's rows, whatever the slice size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators.features import BehavioralFlag, FeatureSpec, build_features
from creditloom.plans.slices import SlicedFrame


def panel(seed, rows=400):
    rng = np.random.default_rng(seed)
    entity = np.where(rng.random(rows) < 0.5, 1, rng.integers(2, 12, rows)).astype(float)
    entity[rng.random(rows) < 0.03] = np.nan
    day = pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 40, rows), unit="D")
    date = pd.Series(day).where(rng.random(rows) > 0.03)
    value = pd.Series(rng.normal(size=rows)).where(rng.random(rows) > 0.1)
    return pd.DataFrame({"id": np.arange(rows), "entity": entity, "date": date, "value": value})


def spark_frame(spark, pdf):
    rows = [
        (int(r.id), None if np.isnan(r.entity) else int(r.entity), None if pd.isna(r.date) else r.date.to_pydatetime(),
         None if pd.isna(r.value) else float(r.value))
        for r in pdf.itertuples()
    ]
    return spark.createDataFrame(rows, "id long, entity long, date timestamp_ntz, value double").repartition(5)


@pytest.mark.parametrize("limit", [1, 3, 17, 60, 10_000])
def test_rolling_mean_over_slices(spark, limit):
    pdf = panel(limit)
    spec = FeatureSpec.empty(rolling_windows=[3, 12], behavioral_flags={"up": BehavioralFlag("value", 0.1, ">=", 6)})
    out = build_features(
        spark_frame(spark, pdf), spec, "date", "entity", ("id",), families=("rolling", "behaviour"),
        rolling_columns=["value"], limit_rows=limit,
    )
    got = out.toPandas().set_index("id").sort_index()
    ordered = pdf.dropna(subset=["entity"]).sort_values(["entity", "date", "id"], na_position="last")
    for w in (3, 12):
        want = ordered.groupby("entity")["value"].rolling(w, min_periods=1).mean().reset_index(level=0, drop=True)
        np.testing.assert_allclose(got[f"value_roll_mean_{w}"], want.reindex(got.index), atol=1e-9)
    roll6 = ordered.groupby("entity")["value"].rolling(6, min_periods=1).mean().reset_index(level=0, drop=True)
    assert (got["behavior_up"] == (roll6.reindex(got.index) >= 0.1).astype(int)).all()
    assert len(got) == len(pdf)


@pytest.mark.parametrize("limit", [5, 10_000])
def test_entity_totals_join_back_to_every_slice(spark, limit):
    pdf = panel(7)
    spec = FeatureSpec.empty(
        numeric_aggregations={"value": ["mean", "max", "min", "std", "count"]}, trend_features=["value"], volatility_features=["value"]
    )
    got = (
        build_features(spark_frame(spark, pdf), spec, "date", "entity", ("id",), limit_rows=limit)
        .toPandas().set_index("id").sort_index()
    )
    g = pdf.groupby("entity")["value"]
    for f in ("mean", "max", "min", "std", "count"):
        want = g.transform(f).astype(float)
        np.testing.assert_allclose(got[f"value_{f}_by_entity"].astype(float), want, atol=1e-9)
    ordered = pdf.sort_values(["entity", "date", "id"], na_position="last").dropna(subset=["entity"])
    ends = ordered.groupby("entity")["value"].agg([lambda s: s.iloc[0], lambda s: s.iloc[-1], "size"])
    ends.columns = ["first", "last", "n"]
    delta = (ends["last"] - ends["first"]).where(ends["n"] > 1, 0.0)
    np.testing.assert_allclose(got["value_delta"], pdf["entity"].map(delta), atol=1e-9)


def test_heavy_entity_is_cut_and_light_ones_are_not(spark):
    pdf = panel(3)
    rows = SlicedFrame(spark_frame(spark, pdf), "entity", "date", ["id"], limit_rows=50).rows
    cuts = {r["entity"]: r["n"] for r in rows.groupBy("entity").agg(F.count_distinct("__slice").alias("n")).collect()}
    assert cuts[1] > 2
    assert all(n == 1 for e, n in cuts.items() if e not in (1, None))
