"""Whole jobs: dataset, training, scoring, evaluation, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scorecard import PointsScale
from creditloom.operators import calibrate as K
from creditloom.operators import jobs as J
from creditloom.operators import models as L
from creditloom.operators.drift import psi
from creditloom.operators.features import EventMarker, FeatureSpec
from creditloom.operators.prep import PrepConfig
from creditloom.operators.store import load_scorer, save_scorer
from creditloom.operators.woe import WoeModel
from creditloom.plans.session import materialize, scratch_path
from creditloom.streaming.scoring import score_stream as run_stream
from creditloom.workload.base import Views, query
from creditloom.workload.history import CFG
from creditloom.workload.models import GIVEN, INPUTS, parts
from creditloom.workload.prep import WOE_SQL
from creditloom.workload.ranking import AP, AUC, BINNED, BRIER, CURVE, ECE, FAIR, KS, LIFT, LOGLOSS, TRAIN_END, VALID_END, _psi_sql

DATASET = """
with cut as (select customer_ref, max(application_date) as cut_date from {application} a group by customer_ref),
s as (select h.customer_ref, avg(cast(coalesce(dpd, 0) as double)) as dpd_value_mean, cast(max(coalesce(dpd, 0)) as double) as dpd_value_max,
    avg(revolving_balance / nullif(credit_limit, 0)) as utilization_mean
  from {history} h join cut c on h.customer_ref = c.customer_ref where statement_date <= cut_date group by h.customer_ref),
m as (select a.application_id, a.customer_ref, a.loan_amount, a.default_flag, d.monthly_income, d.employment_type, s.dpd_value_mean, s.dpd_value_max, s.utilization_mean
  from {application} a left join {demographics} d on a.customer_ref = d.customer_ref left join s on a.customer_ref = s.customer_ref),
q as (select """
NUM = ["loan_amount", "monthly_income", "dpd_value_mean", "dpd_value_max", "utilization_mean"]
DATASET += ", ".join(f"median({c}) as med_{c}, quantile_cont({c}, 0.01) as lo_{c}, quantile_cont({c}, 0.99) as hi_{c}" for c in NUM)
DATASET += """ from m),
e as (select lower(employment_type) as level, (sum(default_flag) + 20 * (select avg(cast(default_flag as double)) from m)) / cast(count(*) + 20 as double) as enc from m group by 1)
select application_id, cast(customer_ref as varchar) as customer_ref, default_flag as "default", """
DATASET += ", ".join(
    f"cast({c} is null as int) as {c}_was_missing, round(least(greatest(coalesce({c}, med_{c}), lo_{c}), hi_{c}), 6) as {c}" for c in NUM
)
DATASET += ", 0 as employment_type_was_missing, round(enc, 9) as employment_type_target from m join e on lower(m.employment_type) = e.level, q"


@query("dataset_job", DATASET)
def dataset_job(v: Views) -> DataFrame:
    sources = {
        "application": v.application.withColumnRenamed("customer_ref", "client_id").withColumnRenamed("default_flag", "bad_flag"),
        "demographics": v.demographics.withColumnRenamed("customer_ref", "cust_id"),
        "loan_details": None,
        "financial_ratios": None,
        "credit_history": v.history.withColumnRenamed("customer_ref", "customer_number"),
    }
    prep = PrepConfig(
        target="default", numeric=NUM, categorical=["employment_type"], log_skew=99.0, encoding="target"
    )
    made = J.build_dataset(sources, prep, CFG, keep=["application_id"]).features
    rounded = [F.round(c, 6).alias(c) if c in NUM else F.col(c) for c in made.columns if c != "employment_type_target"]
    return made.select(*rounded, F.round("employment_type_target", 9).alias("employment_type_target"))


def small_training(v: Views) -> J.Training:
    master = v.panel.withColumnRenamed("default_flag", "default")
    cfg = J.TrainConfig(
        train_end=TRAIN_END,
        valid_end=VALID_END,
        features=FeatureSpec.empty(
            ratios={"loan_to_income": ["loan_amount", "monthly_income"]},
            rolling_windows=[3],
            trend_features=["loan_amount"],
            event_markers={"large": EventMarker("loan_amount", 200000.0)},
            segment_normalization={"monthly_income": "employment_type"},
            volatility_features=["loan_amount"],
        ),
        families=("ratios", "rolling", "trends", "events", "segment_norm", "volatility"),
        rolling_columns=["loan_amount"],
        detection=False,
        sensitive=["region"],
        top_k=3,
        max_pairs=2,
        challengers={
            "boosted": ("boosted", {"maxIter": 3, "maxDepth": 3}),
            "forest": ("forest", {"numTrees": 5, "maxDepth": 4}),
        },
        blend_trials=8,
        stack_folds=2,
    )
    return J.train_job(master, cfg)


@query("train_job_metrics")
def train_job_metrics(v: Views) -> DataFrame:
    return small_training(v).metrics


def small_scorer(v: Views) -> J.Scorer:
    train, valid, _ = parts(v)
    champion = L.train_champion(train, "target", INPUTS)
    scored = champion.score(valid, "p").select(F.col("target").alias("y"), "p")
    return J.Scorer(champion, K.fit_platt(scored), PointsScale())


@query("score_batch")
def score_batch(v: Views) -> DataFrame:
    # One input is left out on purpose: it counts as 0.
    return J.score_job(v.trainset.drop("season"), small_scorer(v), keep=["application_id"])


GIVEN_SLOPE, GIVEN_SHIFT, GIVEN_INTERCEPT = 1.5, -0.2, -1.0
SCALE = PointsScale()
EVEN, SLOPE = SCALE.line()
SCORED_SQL = (
    WOE_SQL
    + ", ct as ("
    + " union all ".join(
        f"select bn.application_id, coalesce(w.woe, 0) * {b!r}e0 as c from bn left join w on bn.feature = w.feature and bn.bin = w.bin where bn.feature = '{f}'"
        for f, b in GIVEN.items()
    )
    + f"""), pr as (select application_id, 1 / (1 + exp(-(sum(c) - 1.0e0))) as p from ct group by application_id),
cal as (select application_id, 1 / (1 + exp(-(p * {GIVEN_SLOPE}e0 + ({GIVEN_SHIFT}e0)))) as pd from pr)
select application_id, round(pd, 9) as pd, round(least(greatest({EVEN!r}e0 + {SLOPE!r}e0 * ln((1 - pd) / pd), 300), 900), 6) as score from cal"""
)


def given_scorer(v: Views, rows: DataFrame) -> J.Scorer:
    """WOE bins fitted here, coefficients and calibration given, so SQL can repeat the scores."""
    woe = WoeModel.fit(rows, list(GIVEN), "default_flag", bins=5, min_samples=50)
    model = L.Champion("logistic_woe", list(GIVEN), woe=woe, coefficients=list(GIVEN.values()), intercept=GIVEN_INTERCEPT)
    return J.Scorer(model, K.Calibrator("platt", GIVEN_SLOPE, GIVEN_SHIFT), SCALE)


def rounded_scores(df: DataFrame) -> DataFrame:
    return df.select("application_id", F.round("pd", 9).alias("pd"), F.round("score", 6).alias("score"))


@query("score_given", SCORED_SQL)
def score_given(v: Views) -> DataFrame:
    return rounded_scores(J.score_job(v.messy, given_scorer(v, v.messy), keep=["application_id"]))


@query("score_saved", SCORED_SQL)
def score_saved(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "scorer")
    save_scorer(v.spark, given_scorer(v, v.messy), path)
    return rounded_scores(J.score_job(v.messy, load_scorer(v.spark, path), keep=["application_id"]))


@query("score_stream", SCORED_SQL)
def score_stream(v: Views) -> DataFrame:
    scorer = given_scorer(v, v.messy)
    arrivals = scratch_path(v.spark, "arrivals")
    rows = v.messy.select("application_id", *GIVEN)
    rows.write.parquet(arrivals)
    sink = scratch_path(v.spark, "scored")
    q = run_stream(v.spark, arrivals, rows.schema, scorer, sink, scratch_path(v.spark, "stream"), ["application_id"])
    q.awaitTermination()
    return rounded_scores(v.spark.read.parquet(sink))


FAIR_EVAL = f"""sz as (select attribute, grp, avg(cast(y as double)) as bad_rate from ({FAIR}) group by 1, 2 having count(*) >= 50),
fg as (select attribute, grp, p, count(*) as n, cast(sum(y) as bigint) as pos from ({FAIR}) group by 1, 2, 3),
fc as (select *, n - pos as neg, sum(n - pos) over (partition by attribute, grp order by p rows between unbounded preceding and current row) as cneg,
  sum(pos) over (partition by attribute, grp) as pt, sum(n - pos) over (partition by attribute, grp) as nt from fg),
fa as (select attribute, grp, sum(pos * (cneg - neg + neg / cast(2 as double))) / nullif(max(pt) * cast(max(nt) as double), 0) as auc from fc group by 1, 2)"""


@query(
    "evaluation_report",
    CURVE
    + BINNED
    + ", "
    + FAIR_EVAL
    + f""", ms as (select {AUC} as roc_auc, {AP} as pr_auc, {KS} as ks, (select {LOGLOSS} from {{scored}} s) as logloss, (select {BRIER} from {{scored}} s) as brier, any_value({ECE}) as ece from c)
select 'metrics' as section, 'roc_auc' as item, cast(null as double) as x, round(roc_auc, 9) as value from ms
union all select 'metrics', 'gini', null, round(2 * roc_auc - 1, 9) from ms
union all select 'metrics', 'pr_auc', null, round(pr_auc, 9) from ms
union all select 'metrics', 'ks', null, round(ks, 9) from ms
union all select 'metrics', 'logloss', null, round(logloss, 9) from ms
union all select 'metrics', 'brier', null, round(brier, 9) from ms
union all select 'metrics', 'ece', null, round(ece, 9) from ms
union all select 'reliability', cast(bin as varchar), round(avg(p), 9), round(avg(cast(y as double)), 9) from b where bin between 0 and 9 group by bin
union all select 'lift', cast(point as varchar), gain, lift from ({LIFT})
union all select 'fairness', sz.attribute || '=' || sz.grp, round(bad_rate, 9), round(auc, 9) from sz left join fa on sz.attribute = fa.attribute and sz.grp = fa.grp""",
)
def evaluation_report(v: Views) -> DataFrame:
    df = v.group_scores.select("y", F.col("p").alias("pd"), (300 + 600 * F.col("p")).alias("score"), "region", "employment_type", "senior")
    out = J.evaluate_job(df, "y", sensitive=["region", "employment_type", "senior"])
    return out.select("section", "item", F.round("x", 9).alias("x"), F.round("value", 9).alias("value"))


@query("training_drift", _psi_sql(["valid", "oot"], False, INPUTS, "trainset"))
def training_drift(v: Views) -> DataFrame:
    frame = materialize(v.trainset.select("split", *INPUTS), "drift")
    return psi(frame, "split", "train", ["valid", "oot"], INPUTS).withColumn("psi", F.round("psi", 9))
