"""Stored scorers, and raw rows scored like the training frame."""

import pytest
from pyspark.sql import functions as F

from creditloom.functions.scorecard import PointsScale
from creditloom.operators import calibrate as K
from creditloom.operators import jobs as J
from creditloom.operators import models as L
from creditloom.operators.features import EventMarker, FeatureSpec
from creditloom.operators.store import load_scorer, save_scorer
from creditloom.plans.session import materialize


def test_every_kind_of_scorer_comes_back_and_scores_raw_rows(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "id as application_id", "id % 50 as customer_ref", "timestamp_ntz'2021-01-01' as application_date",
        "cast(100 + id % 37 as double) as income", "cast(id % 91 as double) as loan", "cast(id % 91 > id % 37 + 30 as int) as target",
    )
    spec = FeatureSpec.empty(ratios={"lti": ["loan", "income"]}, event_markers={"big": EventMarker("loan", 60.0)})
    plain = J.FeatureRecipe(spec, "application_date", "customer_ref", "application_id", False, ("ratios", "events"))
    made = plain.build(rows)
    derived = [c for c in made.columns if c not in rows.columns]
    recipe = J.FeatureRecipe(spec, "application_date", "customer_ref", "application_id", False, ("ratios", "events"), None, ("loan", derived[0]), 1)
    frame = materialize(recipe.apply(rows), "frame")
    inputs = ["income", "loan", *[c for c in frame.columns if c not in rows.columns]]
    assert len(inputs) == 2 + len(derived) + 5
    champion = L.train_champion(frame, "target", inputs, min_samples=5)
    boosted = L.train_trees(frame, "target", inputs, maxIter=1, maxDepth=2)
    forest = L.train_trees(frame, "target", inputs, "forest", numTrees=2, maxDepth=2)
    members = [champion, boosted, forest]
    blend = L.Ensemble("ensemble", [], members=members, weights=[0.2, 0.3, 0.5])
    stack = L.Stacking("stacking", [], members=members, coefficients=[1.0, 2.0, 0.5], intercept=-1.5, threshold=0.4)
    steps = K.fit_isotonic(blend.score(frame, "p").select(F.col("target").alias("y"), "p"))
    for model, calibrator in ((blend, steps), (stack, None)):
        names = [c for c in L.model_inputs(model) if c not in rows.columns]
        scorer = J.Scorer(model, calibrator, PointsScale(), names, recipe)
        save_scorer(spark, scorer, str(tmp_path / model.name))
        back = load_scorer(spark, str(tmp_path / model.name))
        assert back.recipe.spec == spec and list(back.derived) == names and back.model.features == []
        want = J.score_job(frame, scorer, ["application_id"]).select("application_id", F.round("pd", 12), F.round("score", 9))
        got = J.score_raw(rows.drop("target"), back, ["application_id"]).select("application_id", F.round("pd", 12), F.round("score", 9))
        assert got.count() == 400 and got.exceptAll(want).count() == 0
        with pytest.raises(ValueError, match="derived"):
            J.score_job(rows, back)
        with pytest.raises(ValueError, match="derived"):
            J.score_raw(rows.drop("loan"), back)
        assert J.score_raw(rows.drop("loan"), back, ["application_id"], allow_missing=True).filter("pd is null").count() == 0


def test_unknown_models_are_not_stored(spark, tmp_path):
    with pytest.raises(TypeError):
        save_scorer(spark, J.Scorer(L.TrainedModel("x", []), None, PointsScale()), str(tmp_path / "x"))
