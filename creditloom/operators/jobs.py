"""Dataset, training, scoring and evaluation jobs built from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.clean import guess_dates, guess_targets, is_safe_feature, normalize_id, prepare_applications
from creditloom.functions.expr import numeric_columns
from creditloom.functions.scorecard import PointsScale
from creditloom.operators import calibrate, explain
from creditloom.operators import metrics as M
from creditloom.operators import models as L
from creditloom.operators import stats as S
from creditloom.operators.diagnostics import SelectionConfig, diagnose
from creditloom.operators.drift import psi
from creditloom.operators.fairness import fairness_report
from creditloom.operators.factory import FactoryState, apply_factory, fit_factory
from creditloom.operators.features import FAMILIES, FeaturePlan, FeatureSpec, build_features, interaction_candidates, smart_interactions
from creditloom.operators.history import (
    HistoryConfig,
    customer_summary,
    cut_at_application,
    history_features,
    latest_snapshot,
    with_summary_inputs,
)
from creditloom.operators.joins import left_merge, merge_coverage
from creditloom.operators.prep import PrepConfig, PrepModel, fit_prep
from creditloom.operators.rules import needs_cuts
from creditloom.operators.splits import split_by_time
from creditloom.operators.stats import all_null_columns
from creditloom.plans.session import materialize
from creditloom.sources.inventory import scan_folder
from creditloom.sources.readers import SourceConfig, load_master, read_dataset, write_output, write_report


def align_frames(frames: dict[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Union of the splits over the sorted union of their columns; a column a split lacks is NULL there."""
    order = list(columns) if columns else sorted({c for f in frames.values() for c in f.columns})
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames.values())
    return whole.select(*order)


# -- dataset ---------------------------------------------------------------------------------------------


@dataclass
class Dataset:
    features: DataFrame
    master: DataFrame
    coverage: DataFrame
    prep: PrepModel


def build_master(
    sources: dict[str, DataFrame | None], history: HistoryConfig, date: str | None = None, history_spec: FeatureSpec | None = None, panel: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Applications with demographics, loans, ratios and the customer's history summary; and the coverage table."""
    key, app = history.entity, history.application_id
    base = prepare_applications(sources["application"], key, date)
    reports = []
    for name, keys in (("demographics", [key]), ("loan_details", [key, app]), ("financial_ratios", [key])):
        side = sources.get(name)
        reports.append(merge_coverage(base, side, keys, name))
        base = left_merge(base, side, keys, name)
    past = sources.get("credit_history")
    summary = None
    if past is not None:
        if date and date in base.columns:
            past = cut_at_application(past, base, history)
        summary = customer_summary(past, history)
        if panel:
            rows = with_summary_inputs(past, history)
            ties = history.order_columns(past)
            inputs = [c for c in numeric_columns(rows) if c != key and c not in history.tiebreak]
            made = build_features(
                rows, history_spec or FeatureSpec(), date=history.date, entity=key, tiebreak=ties, rolling_columns=inputs
            )
            fresh = [c for c in made.columns if c not in rows.columns and c not in summary.columns]
            if fresh:
                summary = summary.join(latest_snapshot(made, key, history.date, ties, fresh), key, "left")
    reports.append(merge_coverage(base, summary, [key], "credit_history"))
    if summary is not None:
        base = left_merge(base, summary, [key], "credit_history", dedupe=False)
    return base, reduce(DataFrame.unionByName, reports)


def build_dataset(
    sources: dict[str, DataFrame | None],
    prep: PrepConfig,
    history: HistoryConfig = HistoryConfig(),
    date: str | None = "application_date",
    advanced_history: bool = False,
    history_spec: FeatureSpec | None = None,
    panel: bool = True,
    keep: Sequence[str] = (),
) -> Dataset:
    """Identifiers, master table, history features and preprocessing in one go, with the target kept."""
    named = {n: normalize_id(f, n, target=history.entity) if f is not None else None for n, f in sources.items()}
    master, coverage = build_master(named, history, date, history_spec, panel)
    if advanced_history and named.get("credit_history") is not None:
        block = history_features(named["credit_history"], master, history)
        taken = set(master.columns) - {history.application_id}
        block = block.select(*[c for c in block.columns if c not in taken and not c.startswith("history_")])
        master = master.join(block, history.application_id, "left")
    if prep.numeric is not None and prep.categorical is not None:
        # Only these columns are read by the fit and the transform; the rest is never computed for them.
        need = [prep.id_col, prep.target, *keep, *prep.numeric, *prep.categorical]
        table = materialize(master.select(*[c for c in dict.fromkeys(need) if c in master.columns]), "dataset")
    else:
        table = master = materialize(master, "dataset")
    model = fit_prep(table, prep)
    features = model.transform(table, keep=[*keep, prep.target])
    return Dataset(features, master, coverage, model)


# -- training --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TrainConfig:
    target: str = "default"
    date: str = "application_date"
    entity: str = "customer_ref"
    application_id: str = "application_id"
    train_end: str = "2021-12-31"
    valid_end: str = "2022-12-31"
    features: FeatureSpec = field(default_factory=FeatureSpec)
    families: Sequence[str] | None = None
    rolling_columns: Sequence[str] | None = None
    detection: bool = True
    id_like: Sequence[str] = ()
    sensitive: Sequence[str] = ()
    selection: SelectionConfig = SelectionConfig()
    interactions: bool = True
    top_k: int = 12
    max_pairs: int = 20
    min_spearman: float = 0.01
    bins: int = 5
    # One entry per challenger: name -> (kind, parameters).
    challengers: dict[str, tuple[str, dict]] = field(
        default_factory=lambda: {
            "boosted": ("boosted", {"maxIter": 100, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8}),
            "boosted_shallow": ("boosted", {"maxIter": 150, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.85}),
            "forest": ("forest", {"numTrees": 200, "maxDepth": 10}),
        }
    )
    blend_trials: int = 150
    blend_floor: float = 0.05
    blend_metric: str = "roc_auc"
    stack_folds: int = 5
    threshold_metric: str = "f1"
    sanity_sample: int = 20000
    sanity_auc: float = 0.62
    calibrate: bool = True
    scorecard: PointsScale = PointsScale()
    seed: int = 42


@dataclass(frozen=True)
class FeatureRecipe:
    """How the training job made its inputs from raw rows.

    ``fit`` learns the factory's state on the training rows, ``build`` makes their features, and ``apply`` makes those
    of any other row from that state, so they don't depend on the rows that come along with it.
    """

    spec: FeatureSpec
    date: str
    entity: str
    application_id: str
    detection: bool = True
    families: Sequence[str] | None = None
    rolling_columns: Sequence[str] | None = None
    strong: Sequence[str] = ()
    max_pairs: int = 20

    @property
    def _families(self) -> Sequence[str]:
        return FAMILIES if self.families is None else self.families

    def fit(self, train: DataFrame) -> FactoryState:
        return fit_factory(train, self.spec, self.date, self.entity, (self.application_id,), self._families, self.rolling_columns, self.detection)

    def build(self, df: DataFrame, state: FactoryState | None = None) -> DataFrame:
        """Features of the training rows; limits and cuts are those of ``state`` where it is there already."""
        return build_features(
            df,
            self.spec,
            date=self.date,
            entity=self.entity,
            tiebreak=(self.application_id,),
            detection=self.detection,
            families=self._families,
            rolling_columns=self.rolling_columns,
            bounds=state.limits if state else None,
            cuts=state.cuts if state else None,
        )

    def build_from(self, df: DataFrame, state: FactoryState) -> DataFrame:
        """Features of rows that come after the fit."""
        return apply_factory(
            df, state, self.spec, self.date, self.entity, (self.application_id,), self._families, self.rolling_columns, self.detection
        )

    def depends_on_rows(self, df: DataFrame) -> bool:
        """Whether a feature of a row needs anything but the row."""
        plan = FeaturePlan(df, self.spec, self.date, self.entity, (self.application_id,))
        bounds = dict.fromkeys(self.spec.winsorize, (0.0, 0.0))
        plan.declare(self._families, self.rolling_columns, bounds)
        return bool(plan.totals or plan.trailing or plan.segments or plan.limits or (self.detection and needs_cuts(df)))

    def pairs(self, features: DataFrame) -> dict[str, Column]:
        return smart_interactions(features, list(self.strong), self.max_pairs)

    def apply(self, df: DataFrame, state: FactoryState | None = None) -> DataFrame:
        """Features and pairs.  Without a state only features of the row itself can be made."""
        if state is None and self.depends_on_rows(df):
            raise ValueError("features of other rows need the state that fit() learns")
        made = self.build(df) if state is None else self.build_from(df, state)
        # Pairs with a feature that can't be built here are left out; the order of the others stays.
        gone = [c for c in self.strong if c not in made.columns]
        wide = made.select("*", *[F.lit(None).cast("double").alias(c) for c in gone])
        lost = {n for g in gone for c in self.strong for pair in ((g, c), (c, g)) for n in smart_interactions(wide, pair)}
        return wide.select("*", *[c.alias(n) for n, c in self.pairs(wide).items() if n not in lost]).drop(*gone)


@dataclass
class Scorer:
    """Everything scoring needs: model, calibrator and score scale, and how its inputs are made.

    ``derived`` names the inputs that no source delivers.
    """

    model: L.TrainedModel
    calibrator: calibrate.Calibrator | None
    scorecard: PointsScale
    derived: Sequence[str] = ()
    recipe: FeatureRecipe | None = None
    factory: FactoryState | None = None

    def missing(self, df: DataFrame) -> list[str]:
        """Derived inputs that the frame lacks."""
        return [c for c in self.derived if c not in df.columns]

    def score(self, df: DataFrame, allow_missing: bool = False) -> DataFrame:
        """Adds ``pd`` and ``score``; source columns the frame lacks count as 0.  A derived input it lacks raises,
        unless the caller lets it count as 0 too."""
        gone = self.missing(df)
        if gone and not allow_missing:
            raise ValueError(f"these rows lack derived inputs (score_raw builds them): {', '.join(gone)}")
        out = self.model.score(df, "pd")
        if self.calibrator:
            out = self.calibrator.apply(out, "pd")
        return out.withColumn("score", self.scorecard.points(F.col("pd")))


@dataclass
class Training:
    scorer: Scorer
    champion: L.Champion
    models: dict[str, L.TrainedModel]
    diagnostics: DataFrame
    metrics: DataFrame
    drift: DataFrame
    predictions: DataFrame
    scorecard: DataFrame
    reasons: DataFrame
    fairness: DataFrame | None
    columns: list[str]


def feature_recipe(cfg: TrainConfig) -> FeatureRecipe:
    return FeatureRecipe(
        cfg.features, cfg.date, cfg.entity, cfg.application_id, cfg.detection, cfg.families, cfg.rolling_columns, (), cfg.max_pairs
    )


def feature_frame(master: DataFrame, cfg: TrainConfig) -> tuple[DataFrame, FactoryState]:
    """Splits by time, fits the factory on the training split and builds the features of all; and the fitted state."""
    ready = master.filter(F.col(cfg.target).isNotNull() & F.col(cfg.date).isNotNull())
    marked = materialize(split_by_time(ready, cfg.date, cfg.train_end, cfg.valid_end, cfg.application_id), "master")
    recipe = feature_recipe(cfg)
    train, valid, oot = (marked.filter(F.col("split") == name) for name in ("train", "valid", "oot"))
    state = recipe.fit(train)
    frames = {"train": recipe.build(train, state), "valid": recipe.build_from(valid, state), "oot": recipe.build_from(oot, state)}
    return materialize(align_frames(frames), "features"), state


def model_columns(df: DataFrame, cfg: TrainConfig) -> list[str]:
    forbidden = [cfg.entity, cfg.application_id, "split", *cfg.id_like, *cfg.sensitive]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    usable = numeric_columns(df) + [c for c, k in kinds.items() if isinstance(k, (T.StringType, T.BooleanType))]
    empty = set(all_null_columns(df.select(*usable)))
    return [c for c in sorted(usable) if c not in empty and is_safe_feature(c, cfg.target, forbidden)]


def train_job(master: DataFrame, cfg: TrainConfig) -> Training:
    """Features, checks, champion and challengers, blends, calibration and reports."""
    spark = master.sparkSession
    frame, state = feature_frame(master, cfg)
    columns = model_columns(frame, cfg)

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("split") == name)

    checked = materialize(diagnose(part(frame, "train"), part(frame, "valid"), columns, cfg.target, cfg.selection), "diagnostics")
    verdicts = checked.orderBy(F.abs("spearman").desc(), "feature").collect()
    kept = [r["feature"] for r in verdicts if not r["drop"]]
    recipe = feature_recipe(cfg)
    if cfg.interactions:
        ranked = [(r["feature"], r["spearman"]) for r in verdicts if not r["drop"]]
        bad = [r["feature"] for r in verdicts if r["suspicious"]]
        strong = interaction_candidates(
            ranked, frame, cfg.top_k, cfg.min_spearman, [cfg.entity, cfg.application_id, *cfg.id_like], bad
        )
        recipe = replace(recipe, strong=tuple(strong))
        pairs = recipe.pairs(frame)
        frame = frame.select("*", *[c.alias(n) for n, c in pairs.items()])
        kept += list(pairs)
    inputs = sorted(c for c in kept if c in set(numeric_columns(frame)))
    narrow = materialize(frame.select("split", cfg.application_id, cfg.date, cfg.target, *inputs), "training")
    train, valid, oot = (part(narrow, s) for s in ("train", "valid", "oot"))

    champion = L.train_champion(train, cfg.target, inputs, cfg.bins)
    champion.metrics = L.measure(champion, valid, cfg.target)
    fits = {}
    models: dict[str, L.TrainedModel] = {}
    for name, (kind, params) in cfg.challengers.items():
        def fit(df: DataFrame, kind=kind, name=name, params=params) -> L.TreeModel:
            return L.train_trees(df, cfg.target, inputs, kind, name, cfg.seed, **params)

        fits[name] = fit
        m = models[name] = fit(train)
        m.metrics = L.measure(m, valid, cfg.target)
        m.suspicious = L.is_suspicious(m.metrics)
        if not m.suspicious:
            sanity = L.shuffled_auc(fit, train, valid, cfg.target, cfg.application_id, cfg.sanity_sample, cfg.seed)
            m.metrics["sanity_shuffled_auc"] = sanity
            m.suspicious = sanity >= cfg.sanity_auc
    trees = list(models.values())
    if trees:
        models["ensemble"] = L.train_ensemble(
            [champion, *trees], valid, cfg.target, cfg.blend_metric, cfg.blend_trials, cfg.blend_floor, cfg.seed
        )
    if len(trees) > 1:
        models["stacking"] = L.train_stacking(
            list(fits.values()), trees, train, valid, cfg.target, cfg.application_id, cfg.stack_folds, cfg.threshold_metric, cfg.seed
        )
    production = L.choose_production(list(models.values()), champion)

    scored_valid = production.score(valid, "p").select(F.col(cfg.target).cast("int").alias("y"), "p")
    calibrator, fitted = (None, {})
    if cfg.calibrate:
        calibrator, fitted = calibrate.fit_best(scored_valid)
    derived = [c for c in L.model_inputs(production) if c not in master.columns]
    scorer = Scorer(production, calibrator, cfg.scorecard, derived, recipe, state)
    keep = ["split", cfg.application_id, cfg.date, cfg.target]
    predictions = materialize(scorer.score(part(narrow, "valid").unionByName(oot)).select(*keep, "pd", "score"), "predictions")
    after = M.metric_report(predictions.select("split", F.col(cfg.target).cast("int").alias("y"), F.col("pd").alias("p")), keys=["split"])
    rows = [("logistic_woe", k, float(v)) for k, v in champion.metrics.items() if v is not None]
    rows += [(n, k, float(v)) for n, m in models.items() for k, v in m.metrics.items() if v is not None]
    rows += [(n, "suspicious", float(m.suspicious)) for n, m in models.items()]
    rows += [("calibration", k, float(v)) for k, v in fitted.items()]
    rows.append((production.name, "production", 1.0))
    table = spark.createDataFrame(rows, "model string, metric string, value double")
    per_split = M.as_rows(after, ["split"]).select(F.col("split").alias("model"), "metric", "value")
    sensitive = [c for c in cfg.sensitive if c in master.columns]
    fair = None
    if sensitive:
        groups = master.select(cfg.application_id, *sensitive)
        fair = fairness_report(
            predictions.filter("split = 'oot'").join(groups, cfg.application_id), sensitive, cfg.target, "pd", "score"
        )
    return Training(
        scorer=scorer,
        champion=champion,
        models=models,
        diagnostics=checked,
        metrics=table.unionByName(per_split),
        drift=psi(narrow, "split", "train", ["valid", "oot"], inputs),
        predictions=predictions,
        scorecard=explain.scorecard_table(champion, train, cfg.target, cfg.scorecard),
        reasons=explain.champion_reasons(champion, valid, [cfg.application_id]),
        fairness=fair,
        columns=inputs,
    )


# -- scoring and evaluation ------------------------------------------------------------------------------


def score_job(df: DataFrame, scorer: Scorer, keep: Sequence[str] = ()) -> DataFrame:
    """Batch scores of rows that hold the model's inputs: the kept columns with ``pd`` and ``score``."""
    return scorer.score(df).select(*keep, "pd", "score")


def score_raw(df: DataFrame, scorer: Scorer, keep: Sequence[str] = (), allow_missing: bool = False) -> DataFrame:
    """Batch scores of raw rows: features and pairs are built from the fitted state, so a row scores alone as in any batch."""
    made = scorer.recipe.apply(df, scorer.factory) if scorer.recipe else df
    return scorer.score(made, allow_missing).select(*keep, "pd", "score")


def score_sources(
    spark: SparkSession,
    cfg: SourceConfig,
    scorer: Scorer,
    output: str | None = None,
    history: HistoryConfig | None = None,
    evaluation: bool = True,
    keep: Sequence[str] | None = None,
    allow_missing: bool = False,
) -> DataFrame:
    """Scores source files: master table, history block (where ``history`` is given), features, pairs, model and score.

    Rows without a date are left out.  The result holds ``keep`` (by default the ids, the date and the model's inputs
    that are there) with ``pd`` and ``score``; ``output`` writes it by its suffix.
    """
    master, past = load_master(spark, cfg, evaluation)
    recipe = scorer.recipe
    if history is not None and past is not None:
        block = history_features(past, master, history)
        taken = set(master.columns) - {history.application_id}
        master = master.join(block.select(*[c for c in block.columns if c not in taken]), history.application_id, "left")
    if cfg.date in master.columns:
        master = master.filter(F.col(cfg.date).isNotNull())
    made = recipe.apply(master, scorer.factory) if recipe else master
    if keep is None:
        first = [cfg.id_col, recipe.application_id if recipe else "application_id", cfg.date]
        keep = [c for c in dict.fromkeys([*first, *L.model_inputs(scorer.model)]) if c in made.columns]
    scored = scorer.score(made, allow_missing).select(*keep, "pd", "score")
    if output is None:
        return scored
    write_output(scored, output)
    return read_dataset(spark, output)


def evaluate_job(
    predictions: DataFrame, target: str, pred: str = "pd", score: str | None = "score", sensitive: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """``(section, item, x, value)`` rows: metrics, reliability, lift and fairness."""
    base = predictions.select(F.col(target).cast("int").alias("y"), F.col(pred).cast("double").alias("p"))
    none = F.lit(None).cast("double")
    parts = [
        M.as_rows(M.metric_report(base)).select(F.lit("metrics").alias("section"), F.col("metric").alias("item"), none.alias("x"), "value"),
        M.reliability(base, bins=bins).select(
            F.lit("reliability").alias("section"), F.col("bin").cast("string").alias("item"), F.col("mean_pred").alias("x"), F.col("mean_true").alias("value")
        ),
        M.lift_curve(base, bins=bins).select(
            F.lit("lift").alias("section"), F.col("point").cast("string").alias("item"), F.col("gain").alias("x"), F.col("lift").alias("value")
        ),
    ]
    present = [c for c in sensitive if c in predictions.columns]
    if present:
        fair = fairness_report(predictions, present, target, pred, score)
        item = F.concat_ws("=", "attribute", "group")
        parts.append(fair.select(F.lit("fairness").alias("section"), item.alias("item"), F.col("bad_rate").alias("x"), F.col("auc").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def export_explanation(model: L.Champion, df: DataFrame, keys: Sequence[str], path: str, top_k: int = 3) -> str:
    """Intercept, coefficients and reason codes as JSON lines."""
    return write_report(explain.explanation(model, df, keys, top_k), path)


# -- exploration -----------------------------------------------------------------------------------------


def eda_job(df: DataFrame, target: str | None = None, date: str | None = None, histograms: int = 4, bins: int = 30, days: int = 7) -> DataFrame:
    """The tables of an exploration as ``(section, item, x, value, text)``.

    ``describe`` has the statistics of every numeric and text column, ``target_candidate`` and ``date_candidate`` the columns whose names
    suggest one, ``histogram`` the counts of the first numeric columns, ``trend`` the target's mean over the last days seen.
    Without ``target`` and ``date`` the first candidates are taken (for the target only if it is a number).
    """
    numeric = numeric_columns(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    targets, dates = guess_targets(df.columns), guess_dates(df.columns)
    target = target or next((c for c in targets if c in numeric), None)
    date = date or next(iter(dates), None)
    none, blank = F.lit(None).cast("double"), F.lit(None).cast("string")
    parts = []
    if numeric or texts:
        wide = S.describe(df, numeric, texts)
        stats = ["count", "mean", "std", "min", "max", "p25", "p50", "p75", "unique", "freq"]
        cells = [F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value"), blank.alias("text")) for n in stats]
        cells.append(F.struct(F.lit("top").alias("stat"), none.alias("value"), F.col("top").cast("string").alias("text")))
        long = wide.select("column", F.inline(F.array(*cells))).filter("value is not null or text is not null")
        parts.append(long.select(F.lit("describe").alias("section"), F.concat_ws(".", "column", "stat").alias("item"), none.alias("x"), "value", "text"))
    named = [("target_candidate", c) for c in targets] + [("date_candidate", c) for c in dates]
    if named:
        found = df.sparkSession.createDataFrame(named, "section string, item string")
        parts.append(found.select("section", "item", none.alias("x"), none.alias("value"), blank.alias("text")))
    if numeric[:histograms]:
        counts = S.histogram(df, numeric[:histograms], bins)
        parts.append(
            counts.select(
                F.lit("histogram").alias("section"), F.col("feature").alias("item"), F.col("bin").cast("double").alias("x"),
                F.col("n").cast("double").alias("value"), blank.alias("text"),
            )
        )
    if target in df.columns and date in df.columns:
        trend = S.target_trend(df, date, target, days)
        parts.append(
            trend.select(F.lit("trend").alias("section"), F.col("day").cast("string").alias("item"), F.col("rate").alias("x"), F.col("rolling_rate").alias("value"), blank.alias("text"))
        )
    if not parts:
        raise ValueError("nothing to explore: no column")
    return reduce(DataFrame.unionByName, parts)


def eda_folder(spark: SparkSession, folder: str, output: str, target: str | None = None, date: str | None = None, bins: int = 30) -> dict[str, str]:
    """Inventory of a folder and exploration of its first readable dataset, as JSON lines below ``output``."""
    found = materialize(scan_folder(spark, folder), "inventory")
    base = output.rstrip("/")
    first = found.filter("error is null").agg(F.min("path")).first()[0]
    if first is None:
        raise ValueError(f"no readable dataset below {folder}")
    report = eda_job(materialize(read_dataset(spark, first), "explored"), target, date, bins=bins)
    return {"inventory": write_report(found, f"{base}/inventory.jsonl"), "report": write_report(report, f"{base}/eda.jsonl"), "dataset": first}


def save_scorer_metadata(spark: SparkSession, training: Training, path: str) -> None:
    """Report tables next to each other: metrics, drift, diagnostics, scorecard and reasons."""
    for name in ("metrics", "drift", "diagnostics", "scorecard", "reasons"):
        getattr(training, name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
