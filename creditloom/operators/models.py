"""Champion, challengers, blends and stacking on Spark ML.

Training rows are written once as a narrow table (target, weight, inputs) so that each pass of an
iterative fit reads only what it needs and a lost executor re-reads a file.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.clean import safe_features
from creditloom.functions.expr import as_double, numeric_columns
from creditloom.operators import metrics as M
from creditloom.operators.splits import hash_fold, hash_sample
from creditloom.operators.stats import class_weights
from creditloom.operators.woe import WoeModel
from creditloom.plans.ranked import value_table
from creditloom.plans.session import materialize


def balanced_weights(df: DataFrame, target: str) -> dict[int, float]:
    return {int(r[target]): float(r["weight"]) for r in class_weights(df, target).collect()}


def weight_column(target: str, weights: dict[int, float]) -> Column:
    out = F.lit(1.0)
    for cls, w in weights.items():
        out = F.when(F.col(target) == cls, F.lit(w)).otherwise(out)
    return out


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def input_column(df: DataFrame, name: str, fill: float | None = None) -> Column:
    """Model input; a column the frame lacks counts as 0."""
    x = as_double(df, name) if name in df.columns else F.lit(0.0)
    return x if fill is None else F.coalesce(x, F.lit(fill))


#: A fit whose mean weighted residual (less the penalty) is larger for some input has not converged.
MAX_GRADIENT = 1e-3


def logistic_fit(df: DataFrame, inputs: Sequence[str], target: str, weight: str | None, total: float) -> tuple[list[float], float]:
    """Logistic regression with an L2 penalty of strength one on the summed loss."""
    vec = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df)
    lr = LogisticRegression(
        featuresCol="features",
        labelCol=target,
        maxIter=500,
        regParam=1.0 / total,
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-7,
    )
    if weight:
        lr = lr.setWeightCol(weight)
    model = lr.fit(vec)
    coefs, intercept = [float(c) for c in model.coefficients], float(model.intercept)
    # The equations of the maximum: weighted residuals of every input against its penalty, per unit of weight.
    z = F.lit(intercept)
    for c, b in zip(inputs, coefs):
        z = z + F.lit(b) * F.col(c)
    w = F.col(weight) if weight else F.lit(1.0)
    r = w * (F.col(target) - sigmoid(z))
    left = df.agg(F.sum(w), F.sum(r), *[F.sum(r * F.col(c)) for c in inputs]).first()
    slope = max(abs(g - b) for g, b in zip(left[1:], [0.0, *(c * left[0] / total for c in coefs)])) / left[0]
    if not slope <= MAX_GRADIENT:
        raise RuntimeError(f"the logistic fit did not reach its maximum: gradient {slope:.2g}")
    return coefs, intercept


@dataclass
class TrainedModel:
    """A scorer that adds one probability column; ``score`` is the same code for batches and streams."""

    name: str
    features: list[str]
    metrics: dict[str, float] = field(default_factory=dict)
    suspicious: bool = False

    def score(self, df: DataFrame, output: str = "p") -> DataFrame:
        raise NotImplementedError


@dataclass
class Champion(TrainedModel):
    """Logistic regression on WOE values; scoring is one arithmetic expression, no Python and no vectors."""

    woe: WoeModel | None = None
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def probability(self, df: DataFrame) -> Column:
        z = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients):
            z = z + F.lit(b) * self.woe.encode(input_column(df, c), c)
        return sigmoid(z)

    def score(self, df: DataFrame, output: str = "p") -> DataFrame:
        return df.withColumn(output, self.probability(df))


def train_champion(train: DataFrame, target: str, columns: Sequence[str] | None = None, bins: int = 5, min_samples: int = 50) -> Champion:
    numeric = [c for c in (columns or numeric_columns(train)) if c in train.columns]
    inputs = safe_features(numeric, target)
    narrow = materialize(train.select(F.col(target).cast("int").alias(target), *inputs), "champion")
    classes = class_weights(narrow, target).collect()
    total = sum(r["n"] for r in classes)
    weights = {int(r[target]): float(r["weight"]) for r in classes}
    woe = WoeModel.fit(narrow, inputs, target, bins, min_samples, rows=total)
    if not woe.features:
        raise ValueError("no feature gave a usable WOE table")
    encoded = materialize(
        narrow.select(target, weight_column(target, weights).alias("w"), *[woe.encode(as_double(narrow, c), c).alias(c) for c in woe.features]),
        "champion-woe",
    )
    coefs, intercept = logistic_fit(encoded, woe.features, target, "w", float(total))
    return Champion("logistic_woe", woe.features, woe=woe, coefficients=coefs, intercept=intercept)


@dataclass
class TreeModel(TrainedModel):
    model: Model | None = None
    fills: dict[str, float] = field(default_factory=dict)

    def score(self, df: DataFrame, output: str = "p") -> DataFrame:
        own = df.columns
        filled = [input_column(df, c, self.fills.get(c, 0.0)).alias(f"__in_{c}") for c in self.features]
        vec = VectorAssembler(inputCols=[f"__in_{c}" for c in self.features], outputCol="__features")
        out = self.model.transform(vec.transform(df.select("*", *filled)))
        return out.select(*[F.col(c) for c in own if c != output], vector_to_array("__probability")[1].alias(output))

    def importances(self) -> dict[str, float]:
        return {c: float(v) for c, v in zip(self.features, self.model.featureImportances.toArray())}


TREE_KINDS: dict[str, Callable] = {"boosted": GBTClassifier, "forest": RandomForestClassifier}


def train_trees(
    train: DataFrame, target: str, columns: Sequence[str], kind: str = "boosted", name: str | None = None, seed: int = 42, fills: dict[str, float] | None = None, **params
) -> TreeModel:
    """Challenger on numeric inputs; the positive class is weighted by negatives / positives."""
    inputs = safe_features(columns, target)
    # Written before anything is counted, so the rows are worked out once.
    narrow = materialize(train.select(F.col(target).cast("int").alias(target), *[as_double(train, c).alias(c) for c in inputs]), "trees")
    if fills is None:
        row = narrow.agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in inputs]).first()
        fills = {c: float(row[c]) if row[c] is not None else 0.0 for c in inputs}
    counts = {int(r[0]): r[1] for r in narrow.groupBy(target).count().collect()}
    ratio = counts.get(0, 0) / max(counts.get(1, 0), 1)
    ready = narrow.select(
        target,
        F.when(F.col(target) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)).alias("w"),
        *[F.coalesce(c, F.lit(fills[c])).alias(f"__in_{c}") for c in inputs],
    )
    vec = VectorAssembler(inputCols=[f"__in_{c}" for c in inputs], outputCol="__features").transform(ready)
    learner = TREE_KINDS[kind](featuresCol="__features", labelCol=target, weightCol="w", seed=seed)
    learner = learner.setParams(**params).setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__prediction")
    return TreeModel(name or kind, list(inputs), model=learner.fit(vec), fills=fills)


def measure(model: TrainedModel, df: DataFrame, target: str) -> dict[str, float]:
    scored = model.score(df.filter(F.col(target).isNotNull()), "p").select(F.col(target).cast("int").alias("y"), "p")
    row = M.metric_report(scored).first()
    return {m: row[m] for m in M.METRICS}


# -- search and guards -----------------------------------------------------------------------------------


def random_points(space: dict[str, tuple[float, float]], n: int, seed: int = 42) -> list[dict[str, float]]:
    """Distinct random settings: whole ranges for integers, 20 even points for floats."""
    grid = {
        k: list(range(lo, hi + 1)) if isinstance(lo, int) and isinstance(hi, int) else [float(x) for x in np.linspace(lo, hi, 20)]
        for k, (lo, hi) in space.items()
    }
    size = int(np.prod([len(v) for v in grid.values()]))
    picks = np.random.default_rng(seed).choice(size, size=min(n, size), replace=False)
    out = []
    for flat in picks:
        point = {}
        for k, values in grid.items():
            flat, i = divmod(int(flat), len(values))
            point[k] = values[i]
        out.append(point)
    return out


def aucs(df: DataFrame, target: str, columns: Sequence[str]) -> dict[str, float]:
    """AUC of several score columns in one job."""
    t = value_table(df, columns, target).groupBy("feature").agg(M.auc_agg().alias("auc"))
    return {r["feature"]: r["auc"] for r in t.collect()}


def random_search(
    train: DataFrame, valid: DataFrame, target: str, columns: Sequence[str], space: dict[str, tuple[float, float]], n: int = 5, kind: str = "boosted", seed: int = 42, **fixed
) -> list[tuple[dict[str, float], float]]:
    """``(setting, validation AUC)`` in draw order; all candidates are measured in one job."""
    points = random_points(space, n, seed)
    scored = valid
    for i, point in enumerate(points):
        scored = train_trees(train, target, columns, kind, seed=seed, **fixed, **point).score(scored, f"__p{i}")
    found = aucs(scored.select(target, *[f"__p{i}" for i in range(len(points))]), target, [f"__p{i}" for i in range(len(points))])
    return [(p, found[f"__p{i}"]) for i, p in enumerate(points)]


# Metric limits above (Brier: below) which a model is too good to be true.
SUSPICIOUS = {"roc_auc": 0.99, "ks": 0.99, "pr_auc": 0.99, "brier": 0.0001}


def is_suspicious(metrics: dict[str, float], limits: dict[str, float] = SUSPICIOUS) -> bool:
    above = any(metrics.get(k, 0.0) >= limits[k] for k in ("roc_auc", "ks", "pr_auc") if k in limits)
    return above or ("brier" in limits and metrics.get("brier", 1.0) <= limits["brier"])


def shuffled_labels(df: DataFrame, target: str, key: str, sample: int = 20000, seed: int = 42) -> DataFrame:
    """A bounded hash sample whose labels are permuted by pairing two hash orders of the same rows."""
    from pyspark.sql import Window

    rows = hash_sample(df, key, sample, seed)
    one = Window.partitionBy(F.lit(1))
    left = rows.withColumn("__i", F.row_number().over(one.orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), key)))
    labels = rows.select(
        F.col(target).alias("__y"), F.row_number().over(one.orderBy(F.xxhash64(F.col(key), F.lit(seed + 2)), key)).alias("__i")
    )
    return left.join(labels, "__i").withColumn(target, F.col("__y")).drop("__i", "__y")


def shuffled_auc(
    fit: Callable[[DataFrame], TrainedModel], train: DataFrame, valid: DataFrame, target: str, key: str, sample: int = 20000, seed: int = 42
) -> float:
    """Validation AUC of a model fitted on permuted labels; far from one half hints at leakage."""
    model = fit(shuffled_labels(train, target, key, sample, seed))
    scored = model.score(valid.filter(F.col(target).isNotNull()), "p")
    return aucs(scored.select(target, "p"), target, ["p"])["p"]


def choose_production(models: Sequence[TrainedModel], champion: TrainedModel, margin: float = 0.005, ceiling: float = 0.99) -> TrainedModel:
    """The champion unless an unsuspicious model beats the current choice by the margin."""
    best, auc = champion, champion.metrics.get("roc_auc", 0.0)
    for m in models:
        own = m.metrics.get("roc_auc", 0.0)
        if not m.suspicious and own < ceiling and own > auc + margin:
            best, auc = m, own
    return best


# -- blends ----------------------------------------------------------------------------------------------


def blend_candidates(n_models: int, trials: int = 64, min_weight: float = 0.0, seed: int = 42) -> list[list[float]]:
    """Equal weights, each model alone, then random simplex points lifted to the floor."""
    rng = np.random.default_rng(seed)
    out = [np.full(n_models, 1.0 / n_models), *np.eye(n_models)]
    for _ in range(max(trials, 1)):
        w = rng.dirichlet(np.ones(n_models))
        if min_weight > 0:
            w = np.maximum(w, min_weight)
            w = w / w.sum()
        out.append(w)
    return [[float(x) for x in w] for w in out]


def blend(columns: Sequence[str], weights: Sequence[float]) -> Column:
    parts = [F.col(c) * F.lit(float(w)) for c, w in zip(columns, weights)]
    return reduce(lambda a, b: a + b, parts)


def blend_scores(df: DataFrame, columns: Sequence[str], candidates: Sequence[Sequence[float]], target: str, metric: str = "roc_auc") -> DataFrame:
    """``(candidate, value)``: every weighting measured in one job over (candidate, distinct score)."""
    names = [f"c{i}" for i in range(len(candidates))]
    wide = df.select(target, *[blend(columns, w).alias(n) for n, w in zip(names, candidates)])
    t = value_table(wide, names, target)
    value = {"roc_auc": M.auc_agg(), "pr_auc": M.ap_agg(), "f1": F.max(M.fbeta(1.0))}[metric]
    out = t.groupBy("feature").agg(value.alias("value"))
    return out.select(F.substring("feature", 2, 10).cast("int").alias("candidate"), "value")


@dataclass
class Ensemble(TrainedModel):
    members: list[TrainedModel] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, df: DataFrame, output: str = "p") -> DataFrame:
        own = [c for c in df.columns if c != output]
        return with_members(self.members, df).select(*own, blend(member_columns(self.members), self.weights).alias(output))


def member_columns(members: Sequence[TrainedModel]) -> list[str]:
    return [f"__m{i}" for i in range(len(members))]


def with_members(members: Sequence[TrainedModel], df: DataFrame) -> DataFrame:
    for name, m in zip(member_columns(members), members):
        df = m.score(df, name)
    return df


def model_inputs(model: TrainedModel) -> list[str]:
    """Every column a model or one of its members reads."""
    nested = [c for m in getattr(model, "members", []) for c in model_inputs(m)]
    return sorted({*model.features, *nested})


def train_ensemble(
    members: Sequence[TrainedModel], valid: DataFrame, target: str, metric: str = "roc_auc", trials: int = 64, min_weight: float = 0.0, seed: int = 42
) -> Ensemble:
    members = list(members)
    cols = member_columns(members)
    scored = materialize(with_members(members, valid).select(target, *cols), "blend")
    candidates = blend_candidates(len(members), trials, min_weight, seed)
    best = blend_scores(scored, cols, candidates, target, metric).orderBy(F.desc("value"), "candidate").first()
    out = Ensemble("ensemble", [], members=members, weights=candidates[best["candidate"]])
    row = M.metric_report(scored.select(F.col(target).cast("int").alias("y"), blend(cols, out.weights).alias("p"))).first()
    out.metrics = {m: row[m] for m in M.METRICS} | {f"optimized_{metric}": best["value"]}
    out.suspicious = any(m.suspicious for m in members)
    return out


@dataclass
class Stacking(TrainedModel):
    members: list[TrainedModel] = field(default_factory=list)
    coefficients: list[float] | None = None
    intercept: float = 0.0
    threshold: float = 0.5

    def score(self, df: DataFrame, output: str = "p") -> DataFrame:
        own = [c for c in df.columns if c != output]
        cols = member_columns(self.members)
        if self.coefficients is None:
            p = blend(cols, [1.0 / len(cols)] * len(cols))
        else:
            p = sigmoid(blend(cols, self.coefficients) + F.lit(self.intercept))
        return with_members(self.members, df).select(*own, p.alias(output))


def train_stacking(
    fits: Sequence[Callable[[DataFrame], TrainedModel]],
    members: Sequence[TrainedModel],
    train: DataFrame,
    valid: DataFrame,
    target: str,
    key: str,
    folds: int = 5,
    threshold_metric: str = "f1",
    seed: int = 42,
) -> Stacking:
    """Out-of-fold member scores, a balanced logistic on top, used only if it beats the plain mean."""
    members = list(members)
    cols = member_columns(members)
    marked = materialize(train.withColumn("__fold", hash_fold(key, folds, seed)), "stack")
    parts = []
    for k in range(folds):
        inner = [fit(marked.filter(F.col("__fold") != k).drop("__fold")) for fit in fits]
        held = marked.filter(F.col("__fold") == k).drop("__fold")
        parts.append(with_members(inner, held).select(F.col(target).cast("int").alias(target), *cols))
    oof = materialize(reduce(DataFrame.unionByName, parts), "stack-oof")
    weights = balanced_weights(oof, target)
    coefs, intercept = logistic_fit(oof.withColumn("w", weight_column(target, weights)), cols, target, "w", float(oof.count()))
    stacked = Stacking("stacking", [], members=members, coefficients=coefs, intercept=intercept)
    both = materialize(
        with_members(members, valid).select(
            F.col(target).cast("int").alias("y"),
            sigmoid(blend(cols, coefs) + F.lit(intercept)).alias("stacked"),
            blend(cols, [1.0 / len(cols)] * len(cols)).alias("mean"),
        ),
        "stack-valid",
    )
    found = aucs(both, "y", ["stacked", "mean"])
    if found["stacked"] <= found["mean"]:
        stacked.coefficients = None
    final = both.select("y", F.col("stacked" if stacked.coefficients else "mean").alias("p"))
    row = M.metric_report(final).first()
    best = {r["metric"]: r for r in M.best_thresholds(final).collect()}
    stacked.threshold = best[threshold_metric]["threshold"] if threshold_metric in best else 0.5
    stacked.metrics = {m: row[m] for m in M.METRICS} | {
        "stacking_auc": found["stacked"],
        "averaging_auc": found["mean"],
        "optimal_f1_threshold": best["f1"]["threshold"],
        "optimal_f2_threshold": best["f2"]["threshold"],
        "f1_score": best["f1"]["f_score"],
        "f2_score": best["f2"]["f_score"],
    }
    return stacked


# -- importance ------------------------------------------------------------------------------------------


def mean_importance(models: Sequence[TreeModel]) -> list[tuple[str, float]]:
    """Importance averaged over models, strongest first."""
    total: dict[str, list[float]] = {}
    for m in models:
        for c, v in m.importances().items():
            total.setdefault(c, []).append(v)
    return sorted(((c, float(np.mean(v))) for c, v in total.items()), key=lambda t: (-t[1], t[0]))


#: Rows that exchange their values in one bucket.
BUCKET_ROWS = 10_000


def permutation_importance(model: TrainedModel, df: DataFrame, target: str, key: str, columns: Sequence[str], seed: int = 42) -> dict[str, float]:
    """AUC lost when one input is replaced by the same input of another row (pairs by hash bucket order).

    The replacement is the previous row's value in a hash order inside each hash bucket, the first row taking
    the last one's, so no row moves further than its bucket and all columns are measured in one job.  The number
    of buckets follows the number of rows.
    """
    from pyspark.sql import Window

    buckets = max(1, df.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets))
    order = Window.partitionBy(bucket).orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(order) == 1
    moved = df.select("*", *[F.when(first, F.last(c).over(whole)).otherwise(F.lag(c, 1).over(order)).alias(f"__x_{c}") for c in columns])
    scored = model.score(moved, "__base")
    names = ["__base"]
    for c in columns:
        swapped = scored.withColumn("__keep", F.col(c)).withColumn(c, F.col(f"__x_{c}"))
        scored = model.score(swapped, f"__p_{c}").withColumn(c, F.col("__keep")).drop("__keep")
        names.append(f"__p_{c}")
    found = aucs(scored.select(target, *names), target, names)
    return {c: found["__base"] - found[f"__p_{c}"] for c in columns}


def poisson_copies(df: DataFrame, key: str, rate: float, seed: int) -> DataFrame:
    """Bootstrap of ``df``: every row as often as a Poisson draw with mean ``rate`` from the hash of its key.

    The draw depends on key and seed alone, so it is the same however the rows are partitioned.
    """
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**52)) / F.lit(float(2**52))
    n, p, below = F.lit(0), math.exp(-rate), 0.0
    for k in range(1, 64):
        below += p
        if below >= 1.0:
            break
        n = n + (u >= below).cast("int")
        p *= rate / k
    return df.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), n))).drop("__copy")


def stability_selection(
    fit: Callable[[DataFrame], TreeModel], df: DataFrame, key: str, rounds: int = 20, share: float = 0.8, seed: int = 42
) -> list[tuple[str, float]]:
    """Share of bootstrap fits in which a feature's importance reaches the 75th percentile."""
    hits: dict[str, int] = {}
    for i in range(rounds):
        imp = fit(poisson_copies(df, key, share, seed + i)).importances()
        bar = float(np.percentile(list(imp.values()), 75))
        for c, v in imp.items():
            hits[c] = hits.get(c, 0) + int(v >= bar)
    return sorted(((c, h / max(1, rounds)) for c, h in hits.items()), key=lambda t: (-t[1], t[0]))
