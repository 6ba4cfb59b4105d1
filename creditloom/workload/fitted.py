"""The factory fitted on training rows and applied to later ones: features, raw scores, scores of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scorecard import PointsScale
from creditloom.operators import calibrate as K
from creditloom.operators import jobs as J
from creditloom.operators import models as L
from creditloom.operators.features import FeatureSpec
from creditloom.operators.store import load_scorer, save_scorer
from creditloom.operators.woe import WoeModel
from creditloom.plans.session import scratch_path
from creditloom.sources.readers import SourceConfig, write_output
from creditloom.workload.base import Views, query
from creditloom.workload.ranking import TRAIN_END

SPEC = FeatureSpec.empty(
    ratios={"loan_to_income": ["loan_amount", "monthly_income"]},
    numeric_aggregations={"loan_amount": ["mean", "max", "min", "sum", "count"]},
    rolling_windows=[3, 6],
    trend_features=["loan_amount"],
    segment_normalization={"monthly_income": "region"},
    volatility_features=["loan_amount"],
    time_since_event_cols=["default_flag"],
    active_loan_indicator="account_status",
    winsorize={"loan_amount": [0.05, 0.95]},
)
FAMILIES = (
    "ratios", "entity_aggregates", "rolling", "trends", "segment_norm", "volatility", "time_since", "active_loans", "winsorized",
)
RECIPE = J.FeatureRecipe(
    SPEC, "application_date", "customer_ref", "application_id", True, FAMILIES, ["loan_amount"], ("loan_amount_roll_mean_3", "monthly_income_vs_region"), 1
)

#: Made features that the queries return, with the digits they are rounded to.
FEATURES = {
    "loan_to_income": 9, "loan_amount_mean_by_customer_ref": 5, "loan_amount_max_by_customer_ref": 5, "loan_amount_min_by_customer_ref": 5,
    "loan_amount_sum_by_customer_ref": 3, "loan_amount_count_by_customer_ref": 0, "loan_amount_roll_mean_3": 5, "loan_amount_roll_mean_6": 5,
    "loan_amount_delta": 5, "loan_amount_pct_change": 9, "monthly_income_vs_region": 9, "loan_amount_std": 4, "loan_amount_cv": 9,
    "time_since_default_flag": 0, "active_loans_count": 0, "active_loans_share": 9, "loan_amount_winsor": 5, "high_debt_low_income": 0, "extreme_dti": 0,
    "ix_loan_amount_roll_mean_3_x_monthly_income_vs_region": 3,
}

ROWS = "select *, loan_amount / cast(250000 as double) as dti from {panel} p"
MADE = f"""
with rw as ({ROWS}),
tr as (select * from rw where application_date <= timestamp '{TRAIN_END}'),
nw as (select * from rw where application_date > timestamp '{TRAIN_END}'),
g as (select n.application_id as aid, t.application_id, t.application_date, t.loan_amount, t.account_status, t.default_flag from nw n join tr t on n.customer_ref = t.customer_ref
  union all select application_id, application_id, application_date, loan_amount, account_status, default_flag from nw),
k as (select *, row_number() over (partition by aid order by application_date desc, application_id desc) as back,
  row_number() over (partition by aid order by application_date, application_id) as forth from g),
a as (select aid, count(*) as n, avg(loan_amount) as mean, max(loan_amount) as top, min(loan_amount) as low, sum(loan_amount) as total,
    avg(loan_amount) filter (where back <= 3) as roll3, avg(loan_amount) filter (where back <= 6) as roll6,
    max(loan_amount) filter (where back = 1) as latest, max(loan_amount) filter (where forth = 1) as earliest,
    coalesce(stddev_samp(loan_amount), 0) as sd, max(application_date) as last_date, max(application_date) filter (where default_flag > 0) as event,
    count(*) filter (where lower(account_status) in ('active', 'current', 'open', '1', 'true')) as active, count(account_status) as status
  from k group by aid),
sg as (select region, avg(monthly_income) as income from tr group by region),
lm as (select quantile_cont(loan_amount, 0.05) as lo, quantile_cont(loan_amount, 0.95) as hi, quantile_cont(monthly_income, 0.3) as q30 from tr),
f as (select n.application_id,
    n.loan_amount / nullif(n.monthly_income, 0) as loan_to_income,
    mean as loan_amount_mean_by_customer_ref, top as loan_amount_max_by_customer_ref, low as loan_amount_min_by_customer_ref,
    total as loan_amount_sum_by_customer_ref, cast(a.n as double) as loan_amount_count_by_customer_ref,
    roll3 as loan_amount_roll_mean_3, roll6 as loan_amount_roll_mean_6,
    case when a.n > 1 then latest - earliest else 0 end as loan_amount_delta,
    case when a.n > 1 then (latest - earliest) / (abs(earliest) + 1e-6) else 0 end as loan_amount_pct_change,
    n.monthly_income / (sg.income + 1e-6) as monthly_income_vs_region,
    sd as loan_amount_std, sd / nullif(mean, 0) as loan_amount_cv,
    cast(floor(epoch(last_date - event) / 86400) as double) as time_since_default_flag,
    cast(active as double) as active_loans_count, active / cast(nullif(status, 0) as double) as active_loans_share,
    least(greatest(n.loan_amount, lo), hi) as loan_amount_winsor,
    cast(coalesce(n.dti > 0.6 and n.monthly_income < q30, false) as double) as high_debt_low_income,
    cast(n.dti > 0.85 as double) as extreme_dti,
    roll3 * (n.monthly_income / (sg.income + 1e-6)) as ix_loan_amount_roll_mean_3_x_monthly_income_vs_region
  from nw n join a on a.aid = n.application_id left join sg on sg.region = n.region, lm)"""


def split(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = v.spark.sql(ROWS, panel=v.panel)
    return rows.filter(f"application_date <= timestamp_ntz'{TRAIN_END}'"), rows.filter(f"application_date > timestamp_ntz'{TRAIN_END}'")


@query("factory_fitted", MADE + " select application_id, " + ", ".join(f"round({c}, {d}) as {c}" for c, d in FEATURES.items()) + " from f")
def factory_fitted(v: Views) -> DataFrame:
    train, new = split(v)
    made = RECIPE.apply(new, RECIPE.fit(train))
    return made.select("application_id", *[F.round(F.col(c).cast("double"), d).alias(c) for c, d in FEATURES.items()])


# A model given by hand, so that SQL can repeat it: edges and weights of evidence of four made features.
GIVEN = {
    "loan_amount_mean_by_customer_ref": ([0.0, 120000.0, 150000.0, 1e9], [-0.3, 0.1, 0.4], 0.8),
    "monthly_income_vs_region": ([0.0, 0.5, 1.2, 1e6], [0.5, 0.0, -0.6], 1.1),
    "loan_amount_winsor": ([0.0, 100000.0, 200000.0, 1e9], [-0.2, 0.3, 0.7], 0.9),
    "high_debt_low_income": ([-0.5, 0.5, 1.5], [-0.1, 1.3], 1.0),
}
SLOPE, SHIFT, INTERCEPT = 1.5, -0.2, -0.7
SCALE = PointsScale()
EVEN, LINE = SCALE.line()


def _term(c: str) -> str:
    edges, woe, weight = GIVEN[c]
    cases = " ".join(f"when {c} <= {e!r} then {w!r}" for e, w in zip(edges[1:], woe))
    return f"{weight!r}e0 * (case when {c} is null or {c} < {edges[0]!r} or {c} > {edges[-1]!r} then 0 {cases} end)"


SCORED = (
    MADE
    + f""", pr as (select application_id, 1 / (1 + exp(-({INTERCEPT!r}e0 + {" + ".join(_term(c) for c in GIVEN)}))) as p from f),
cal as (select application_id, 1 / (1 + exp(-(p * {SLOPE}e0 + ({SHIFT}e0)))) as pd from pr)
select application_id, round(pd, 9) as pd, round(least(greatest({EVEN!r}e0 + {LINE!r}e0 * ln((1 - pd) / pd), 300), 900), 6) as score from cal"""
)


def fitted_scorer(train: DataFrame) -> J.Scorer:
    woe = WoeModel({c: e for c, (e, _, _) in GIVEN.items()}, {c: dict(enumerate(w, 1)) for c, (_, w, _) in GIVEN.items()})
    model = L.Champion("logistic_woe", list(GIVEN), woe=woe, coefficients=[b for _, _, b in GIVEN.values()], intercept=INTERCEPT)
    derived = [c for c in GIVEN if c not in train.columns]
    return J.Scorer(model, K.Calibrator("platt", SLOPE, SHIFT), SCALE, derived, RECIPE, RECIPE.fit(train))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(F.col("application_id").cast("long").alias("application_id"), F.round("pd", 9).alias("pd"), F.round("score", 6).alias("score"))


@query("score_raw_batch", SCORED)
def score_raw_batch(v: Views) -> DataFrame:
    """Stored and loaded before it scores the rows after the training period."""
    train, new = split(v)
    path = scratch_path(v.spark, "scorer")
    save_scorer(v.spark, fitted_scorer(train), path)
    return _rounded(J.score_raw(new, load_scorer(v.spark, path), keep=["application_id"]))


@query("score_sources", SCORED)
def score_sources(v: Views) -> DataFrame:
    """The same scores from source files: applications in CSV, demographics in CSV, ratios in JSON lines."""
    train, new = split(v)
    base = scratch_path(v.spark, "sources")
    day = F.date_format("application_date", "yyyy-MM-dd").alias("application_date")
    app = new.select("customer_ref", "application_id", day, "loan_amount", "account_status", "default_flag", "dti")
    write_output(app, f"{base}/application_metadata.csv")
    people = new.dropDuplicates(["customer_ref"])
    write_output(people.select(F.col("customer_ref").alias("cust_id"), "region", "employment_type", "age"), f"{base}/demographics.csv")
    people.select(F.col("customer_ref").alias("cust_num"), "monthly_income").write.json(f"{base}/financial_ratios.jsonl")
    out = J.score_sources(v.spark, SourceConfig(base), fitted_scorer(train), f"{scratch_path(v.spark, 'scored')}.csv", evaluation=False)
    return _rounded(out)
