"""The fitted factory: rows get the same features alone, in a batch and from a stored scorer."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from creditloom.functions.scorecard import PointsScale
from creditloom.operators import jobs as J
from creditloom.operators import models as L
from creditloom.operators.features import BehavioralFlag, FeatureSpec
from creditloom.operators.store import load_scorer, save_scorer

SCHEMA = "application_id long, customer_ref string, application_date timestamp_ntz, loan double, income double, region string, late int, dti double, account_status string"


def rows(seed, n, first, year):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        day = None if rng.random() < 0.05 else dt.datetime(year, 1, 1) + dt.timedelta(days=rng.randrange(200))
        who = rng.choice(["hot"] * 4 + ["a", "b", "c", None, f"own{seed}"])
        out.append(
            (first + i, who, day, rng.choice([None, rng.uniform(1, 100)]), rng.uniform(1, 9), rng.choice(["n", "s", None, f"r{seed}"]),
             rng.choice([0, 0, 1, None]), rng.random(), rng.choice(["Active", "closed", None]))
        )
    return out


SPEC = FeatureSpec.empty(
    ratios={"lti": ["loan", "income"]},
    numeric_aggregations={"loan": ["mean", "max", "min", "std", "sum", "count"]},
    rolling_windows=[1, 2, 4],
    trend_features=["loan"],
    behavioral_flags={"late": BehavioralFlag("late", 1, ">=", 3), "big": BehavioralFlag("loan", 50.0)},
    volatility_features=["loan"],
    time_since_event_cols=["late"],
    active_loan_indicator="account_status",
    winsorize={"loan": [0.1, 0.9]},
)
FAMILIES = ("ratios", "entity_aggregates", "rolling", "trends", "behaviour", "segment_norm", "volatility", "time_since", "active_loans", "winsorized")
PLAIN = J.FeatureRecipe(SPEC, "application_date", "customer_ref", "application_id", True, FAMILIES, ["loan", "late"])
FULL = J.FeatureRecipe(
    FeatureSpec(**{**vars(SPEC), "segment_normalization": {"income": "region"}}), *list(vars(PLAIN).values())[1:7], ("loan_mean_by_customer_ref", "income_vs_region"), 1
)


def same(a, b):
    if a is None or b is None:
        return a is b
    return a == pytest.approx(b, rel=1e-9, abs=1e-9) if isinstance(a, float) else a == b


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(rows(1, 120, 0, 2020), SCHEMA).repartition(4)


def test_a_row_sees_the_training_rows_of_its_entity_and_itself(spark, train):
    new = rows(2, 12, 1000, 2021)
    state = PLAIN.fit(train)
    got = {r.application_id: r for r in PLAIN.apply(spark.createDataFrame(new, SCHEMA), state).collect()}
    known = {r.customer_ref for r in train.select("customer_ref").distinct().collect()}
    assert len({r[1] in known for r in new}) == 2 and any(r[1] is None for r in new) and any(r[2] is None for r in new)
    for row in new:
        together = train.unionByName(spark.createDataFrame([row], SCHEMA))
        want = PLAIN.build(together, state).filter(F.col("application_id") == row[0]).first()
        assert set(want.asDict()) == set(got[row[0]].asDict())
        for name, value in want.asDict().items():
            if row[2] is None and ("_roll_" in name or name == "behavior_late"):
                continue  # windows of undated rows see fewer rows
            assert same(got[row[0]][name], value), (row, name, got[row[0]][name], value)


def test_alone_as_in_any_batch_and_from_a_stored_scorer(spark, train, tmp_path):
    new = spark.createDataFrame(rows(3, 40, 2000, 2021), SCHEMA)
    state = FULL.fit(train)
    batch = {r.application_id: r for r in FULL.apply(new, state).collect()}
    assert {"income_vs_region", "loan_winsor", "high_debt_low_income", "ix_loan_mean_by_customer_ref_x_income_vs_region"} <= set(batch[2000].asDict())
    for i in (2000, 2007, 2013, 2021, 2039):
        alone = FULL.apply(new.filter(F.col("application_id") == i), state).first()
        assert alone == batch[i]
    champion = L.train_champion(
        FULL.build(train, state).withColumn("target", F.when(F.col("late") > 0, 1).otherwise(0)), "target", ["loan_mean_by_customer_ref", "income"], min_samples=5
    )
    scorer = J.Scorer(champion, None, PointsScale(), ["loan_mean_by_customer_ref"], FULL, state)
    save_scorer(spark, scorer, str(tmp_path / "scorer"))
    back = load_scorer(spark, str(tmp_path / "scorer"))
    assert back.factory.limits == state.limits and back.factory.cuts == state.cuts
    want = {r.application_id: (r.pd, r.score) for r in J.score_raw(new, scorer, ["application_id"]).collect()}
    got = {r.application_id: (r.pd, r.score) for r in J.score_raw(new, back, ["application_id"]).collect()}
    assert got == want and len(set(got.values())) > 3
    one = J.score_raw(new.filter("application_id = 2007"), back, ["application_id"]).first()
    assert (one.pd, one.score) == got[2007]


def test_no_state_empty_state_and_no_rows(spark, train):
    new = spark.createDataFrame(rows(4, 5, 3000, 2021), SCHEMA)
    with pytest.raises(ValueError, match="fit"):
        FULL.apply(new)
    empty = FULL.fit(train.limit(0))
    made = FULL.apply(new, empty).collect()
    assert len(made) == 5 and all(r["income_vs_region"] is None for r in made) and "loan_winsor" not in made[0].asDict()
    assert FULL.apply(new.limit(0), FULL.fit(train)).count() == 0
