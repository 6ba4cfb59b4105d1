"""Scorers on shared storage: a JSON text with every fitted number, Spark ML models in folders beside it.

``save_scorer`` replaces what the path holds; ``load_scorer`` gives a scorer that scores like the stored one, in
any session.  An unknown kind of model raises.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import SparkSession

from creditloom.functions.scorecard import PointsScale
from creditloom.operators.calibrate import Calibrator
from creditloom.operators.factory import FactoryState
from creditloom.operators.features import BehavioralFlag, EventMarker, FeatureSpec
from creditloom.operators.jobs import FeatureRecipe, Scorer
from creditloom.operators.models import Champion, Ensemble, Stacking, TrainedModel, TreeModel
from creditloom.operators.woe import WoeModel

TREES = {c.__name__: c for c in (GBTClassificationModel, RandomForestClassificationModel)}


def _model_state(model: TrainedModel, path: str) -> dict:
    state = {"name": model.name, "features": model.features, "metrics": model.metrics, "suspicious": model.suspicious}
    if isinstance(model, Champion):
        woe = {"edges": model.woe.edges, "woe": model.woe.woe}
        return state | {"kind": "champion", "woe": woe, "coefficients": model.coefficients, "intercept": model.intercept}
    if isinstance(model, TreeModel):
        model.model.write().overwrite().save(path)
        return state | {"kind": "trees", "model": type(model.model).__name__, "fills": model.fills}
    if not isinstance(model, (Ensemble, Stacking)):
        raise TypeError(f"cannot store a {type(model).__name__}")
    state["members"] = [_model_state(m, f"{path}_{i}") for i, m in enumerate(model.members)]
    if isinstance(model, Ensemble):
        return state | {"kind": "ensemble", "weights": model.weights}
    return state | {"kind": "stacking", "coefficients": model.coefficients, "intercept": model.intercept, "threshold": model.threshold}


def _model_from(state: dict, path: str) -> TrainedModel:
    state = dict(state)
    kind = state.pop("kind")
    if kind == "champion":
        woe = state.pop("woe")
        bins = {c: {int(b): v for b, v in m.items()} for c, m in woe["woe"].items()}
        return Champion(**state, woe=WoeModel(woe["edges"], bins))
    if kind == "trees":
        return TreeModel(**{**state, "model": TREES[state["model"]].load(path)})
    members = [_model_from(m, f"{path}_{i}") for i, m in enumerate(state.pop("members"))]
    return {"ensemble": Ensemble, "stacking": Stacking}[kind](**state, members=members)


def _spec_from(state: dict) -> FeatureSpec:
    marks = {k: EventMarker(**o) for k, o in state["event_markers"].items()}
    flags = {k: BehavioralFlag(**o) for k, o in state["behavioral_flags"].items()}
    return FeatureSpec(**{**state, "event_markers": marks, "behavioral_flags": flags})


def _factory_state(state: FactoryState, path: str) -> dict:
    """Segment means and entity states go to tables, which may be large."""
    names = sorted(state.segments)
    for i, name in enumerate(names):
        state.segments[name].write.mode("overwrite").parquet(f"{path}/segment_{i}")
    if state.entities is not None:
        state.entities.write.mode("overwrite").parquet(f"{path}/entities")
    return {"limits": state.limits, "cuts": state.cuts, "segments": names, "entities": state.entities is not None}


def _factory_from(spark: SparkSession, state: dict, path: str) -> FactoryState:
    segments = {name: spark.read.parquet(f"{path}/segment_{i}") for i, name in enumerate(state["segments"])}
    entities = spark.read.parquet(f"{path}/entities") if state["entities"] else None
    return FactoryState({c: tuple(b) for c, b in state["limits"].items()}, state["cuts"], segments, entities)


def save_scorer(spark: SparkSession, scorer: Scorer, path: str) -> None:
    path = path.rstrip("/")
    c = scorer.calibrator
    state = {
        "model": _model_state(scorer.model, f"{path}/model"),
        "calibrator": {"method": c.method, "slope": c.slope, "intercept": c.intercept, "steps": c.steps} if c else None,
        "scale": asdict(scorer.scorecard),
        "derived": list(scorer.derived),
        "recipe": asdict(scorer.recipe) if scorer.recipe else None,
        "factory": _factory_state(scorer.factory, f"{path}/factory") if scorer.factory else None,
    }
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/scorer")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    path = path.rstrip("/")
    state = json.loads("".join(r[0] for r in spark.read.text(f"{path}/scorer").collect()))
    c, recipe = state["calibrator"], state["recipe"]
    if c:
        c = Calibrator(**{**c, "steps": [tuple(x) for x in c["steps"]]})
    if recipe:
        recipe = FeatureRecipe(**{**recipe, "spec": _spec_from(recipe["spec"])})
    factory = _factory_from(spark, state["factory"], f"{path}/factory") if state.get("factory") else None
    return Scorer(_model_from(state["model"], f"{path}/model"), c, PointsScale(**state["scale"]), tuple(state["derived"]), recipe, factory)
