"""Feature-factory queries on applications joined with demographics, and on the event panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.features import (
    BehavioralFlag,
    EventMarker,
    FeatureSpec,
    build_features,
    smart_interactions,
)
from creditloom.operators.rules import detection_features
from creditloom.workload.base import VIEW_SQL, Views, query

# A frame with the column names the rule pack looks for, made from the panel.
VIEW_SQL["applicant"] = """
select application_id, customer_ref, application_date, default_flag,
       cast(300 + (application_id * 37) % 550 as int) as credit_score,
       monthly_income * 12 as annual_income,
       loan_amount / nullif(monthly_income * 40, 0) as debt_to_income_ratio,
       age,
       loan_amount / cast(400000 as double) as credit_utilization,
       cast((customer_ref * 13) % 12 as double) as employment_length,
       case when account_status = 'F' then 2 when default_flag = 1 then 1 end as num_delinquencies,
       coalesce(monthly_income, 0) - loan_amount / 50 as monthly_free_cash_flow,
       cast((application_id * 11) % 9 as int) as num_customer_service_calls,
       cast((application_id * 17) % 23 as int) as num_login_sessions,
       cast(age as double) / 500 as regional_unemployment_rate,
       cast(48000 as double) as regional_median_income,
       case when account_status = 'P' then 1 else 0 end as num_collections,
       cast(application_id % 24 as int) as application_hour,
       cast(application_id % 7 as int) as application_day_of_week
from {panel} x"""

TB = ("application_id",)


def panel_features(v: Views, *families: str, **spec) -> DataFrame:
    return build_features(
        v.panel,
        FeatureSpec.empty(**spec),
        date="application_date",
        entity="customer_ref",
        tiebreak=TB,
        families=families,
        rolling_columns=["loan_amount", "monthly_income"],
    )


def out(df: DataFrame, *names: str, digits: int = 6, ints: tuple = (), keys=("application_id",)) -> DataFrame:
    return df.select(
        *keys,
        *[F.round(n, digits).alias(n) for n in names],
        *[F.col(n).cast("int").alias(n) for n in ints],
    )


@query(
    "ratios",
    """
select application_id, round(loan_amount / nullif(monthly_income, 0), 6) as loan_to_income,
       round(monthly_income / nullif(cast(age as double), 0), 6) as income_per_year
from {panel} x""",
)
def ratios(v: Views) -> DataFrame:
    f = panel_features(
        v, "ratios", ratios={"loan_to_income": ["loan_amount", "monthly_income"], "income_per_year": ["monthly_income", "age"]}
    )
    return out(f, "loan_to_income", "income_per_year")


@query(
    "numeric_aggs",
    """
select application_id,
       round(avg(loan_amount) over w, 7) as loan_amount_mean_by_customer_ref,
       max(loan_amount) over w as loan_amount_max_by_customer_ref,
       min(loan_amount) over w as loan_amount_min_by_customer_ref,
       round(stddev_samp(loan_amount) over w, 4) as loan_amount_std_by_customer_ref,
       cast(count(monthly_income) over w as bigint) as monthly_income_count_by_customer_ref
from {panel} x window w as (partition by customer_ref)""",
)
def numeric_aggs(v: Views) -> DataFrame:
    f = panel_features(
        v,
        "entity_aggregates",
        numeric_aggregations={"loan_amount": ["mean", "max", "min", "std"], "monthly_income": ["count"]},
    )
    p = "loan_amount_{}_by_customer_ref"
    return f.select(
        "application_id",
        F.round(p.format("mean"), 7).alias(p.format("mean")),
        p.format("max"),
        p.format("min"),
        F.round(p.format("std"), 4).alias(p.format("std")),
        F.col("monthly_income_count_by_customer_ref").cast("bigint").alias("monthly_income_count_by_customer_ref"),
    )


ROLLS = [(c, w) for w in (3, 6, 12) for c in ("loan_amount", "monthly_income")]


@query(
    "rolling_means",
    "select application_id, "
    + ", ".join(
        f"round(avg({c}) over (partition by customer_ref order by application_date, application_id rows between {w - 1} preceding and current row), 7) as {c}_roll_mean_{w}"
        for c, w in ROLLS
    )
    + " from {panel} x",
)
def rolling_means(v: Views) -> DataFrame:
    f = panel_features(v, "rolling", rolling_windows=[3, 6, 12])
    return out(f, *[f"{c}_roll_mean_{w}" for c, w in ROLLS], digits=7)


@query(
    "trends",
    """
with o as (
  select application_id, count(*) over w as n,
    first_value(loan_amount) over w as f1, last_value(loan_amount) over w as l1,
    first_value(value_b) over w as f2, last_value(value_b) over w as l2
  from (select *, case when loan_purpose = '1-URGENT' then null else loan_amount end as value_b from {panel} x) y
  window w as (partition by customer_ref order by application_date, application_id rows between unbounded preceding and unbounded following)
)
select application_id,
  round(case when n > 1 then l1 - f1 else 0 end, 6) as loan_amount_delta,
  round(case when n > 1 then (l1 - f1) / (abs(f1) + cast(0.000001 as double)) else 0 end, 6) as loan_amount_pct_change,
  round(case when n > 1 then l2 - f2 else 0 end, 6) as value_b_delta,
  round(case when n > 1 then (l2 - f2) / (abs(f2) + cast(0.000001 as double)) else 0 end, 6) as value_b_pct_change
from o""",
)
def trends(v: Views) -> DataFrame:
    df = v.panel.withColumn("value_b", F.when(F.col("loan_purpose") != "1-URGENT", F.col("loan_amount")))
    f = build_features(
        df,
        FeatureSpec.empty(trend_features=["loan_amount", "value_b"]),
        date="application_date",
        entity="customer_ref",
        tiebreak=TB,
        families=("trends",),
    )
    return out(f, "loan_amount_delta", "loan_amount_pct_change", "value_b_delta", "value_b_pct_change")


@query(
    "delinquency",
    """
with m as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when payment_amount is null then null when dpd >= 30 then 1 else 0 end as dpd_30_flag,
  case when dpd >= 60 then 1 else 0 end as dpd_60_flag,
  case when dpd >= 90 then 1 else 0 end as dpd_90_flag from {history} h)
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  cast(coalesce(dpd_30_flag, 0) + dpd_60_flag + dpd_90_flag as double) as delinq_sum,
  cast(greatest(coalesce(dpd_30_flag, 0), dpd_60_flag, dpd_90_flag) as double) as delinq_max,
  cast(coalesce(dpd_30_flag, 0) > 0 or dpd_60_flag > 0 or dpd_90_flag > 0 as int) as delinq_any_30
from m""",
)
def delinquency(v: Views) -> DataFrame:
    ids = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    h = v.history.select(
        *ids,
        F.when(F.col("payment_amount").isNotNull(), (F.col("dpd") >= 30).cast("int")).alias("dpd_30_flag"),
        (F.col("dpd") >= 60).cast("int").alias("dpd_60_flag"),
        (F.col("dpd") >= 90).cast("int").alias("dpd_90_flag"),
    )
    f = build_features(h, FeatureSpec(), families=("delinquency",))
    return f.select(*ids, "delinq_sum", "delinq_max", "delinq_any_30")


@query(
    "segment_norm",
    """
select application_id,
  round(monthly_income / (avg(monthly_income) over (partition by region) + cast(0.000001 as double)), 6) as monthly_income_vs_region,
  round(loan_amount / (avg(loan_amount) over (partition by employment_type) + cast(0.000001 as double)), 6) as loan_amount_vs_employment_type
from {panel} x""",
)
def segment_norm(v: Views) -> DataFrame:
    f = panel_features(
        v, "segment_norm", segment_normalization={"monthly_income": "region", "loan_amount": "employment_type"}
    )
    return out(f, "monthly_income_vs_region", "loan_amount_vs_employment_type")


@query(
    "volatility",
    """
select application_id,
  round(coalesce(stddev_samp(loan_amount) over w, 0), 4) as loan_amount_std,
  round(coalesce(stddev_samp(loan_amount) over w, 0) / nullif(avg(loan_amount) over w, 0), 6) as loan_amount_cv
from {panel} x window w as (partition by customer_ref)""",
)
def volatility(v: Views) -> DataFrame:
    f = panel_features(v, "volatility", volatility_features=["loan_amount"])
    return f.select("application_id", F.round("loan_amount_std", 4).alias("loan_amount_std"), F.round("loan_amount_cv", 6).alias("loan_amount_cv"))


@query(
    "time_since_event",
    """
select event_id, cast(date_sub('day', max(case when error_flag > 0 then ts end) over w, max(ts) over w) as bigint) as time_since_error_flag
from {event_flags} e window w as (partition by user_id)""",
)
def time_since_event(v: Views) -> DataFrame:
    f = build_features(
        v.event_flags,
        FeatureSpec.empty(time_since_event_cols=["error_flag"]),
        date="ts",
        entity="user_id",
        tiebreak=("event_id",),
        families=("time_since",),
    )
    return f.select("event_id", F.col("time_since_error_flag").cast("bigint").alias("time_since_error_flag"))


@query(
    "active_loans",
    """
with s as (select application_id, customer_ref,
  case when account_status = 'O' then 'Open' when account_status = 'P' then null else 'closed' end as account_status from {panel} x)
select application_id,
  cast(sum(case when lower(account_status) in ('active', 'current', 'open', '1', 'true') then 1 else 0 end) over w as bigint) as active_loans_count,
  round(sum(case when lower(account_status) in ('active', 'current', 'open', '1', 'true') then 1 else 0 end) over w
        / nullif(cast(count(account_status) over w as double), 0), 6) as active_loans_share
from s window w as (partition by customer_ref)""",
)
def active_loans(v: Views) -> DataFrame:
    status = F.when(F.col("account_status") == "O", "Open").when(F.col("account_status") != "P", "closed")
    f = build_features(
        v.panel.withColumn("account_status", status),
        FeatureSpec.empty(active_loan_indicator="account_status"),
        entity="customer_ref",
        tiebreak=TB,
        families=("active_loans",),
    )
    return f.select(
        "application_id",
        F.col("active_loans_count").cast("bigint").alias("active_loans_count"),
        F.round("active_loans_share", 6).alias("active_loans_share"),
    )


@query(
    "behavior_flags",
    """
select application_id,
  cast(coalesce(avg(loan_amount) over (partition by customer_ref order by application_date, application_id rows between 5 preceding and current row) >= 150000, false) as int) as behavior_big_borrower,
  cast(coalesce(monthly_income <= 1000, false) as int) as behavior_low_income,
  cast(coalesce(age == 30, false) as int) as behavior_thirty
from {panel} x""",
)
def behavior_flags(v: Views) -> DataFrame:
    f = panel_features(
        v,
        "behaviour",
        behavioral_flags={
            "big_borrower": BehavioralFlag("loan_amount", 150000.0, ">=", 6),
            "low_income": BehavioralFlag("monthly_income", 1000.0, "<="),
            "thirty": BehavioralFlag("age", 30.0, "=="),
        },
    )
    return out(f, ints=("behavior_big_borrower", "behavior_low_income", "behavior_thirty"))


@query(
    "event_flags",
    """
select application_id,
  cast(coalesce(monthly_income, 0) >= 5000 as int) as event_good_income,
  cast(coalesce(monthly_income, 0) < 100 as int) as event_no_income,
  cast(loan_amount > 200000 as int) as event_large_loan
from {panel} x""",
)
def event_flags(v: Views) -> DataFrame:
    f = panel_features(
        v,
        "events",
        event_markers={
            "good_income": EventMarker("monthly_income", 5000.0),
            "no_income": EventMarker("monthly_income", 100.0, "<"),
            "large_loan": EventMarker("loan_amount", 200000.0, ">"),
        },
    )
    return out(f, ints=("event_good_income", "event_no_income", "event_large_loan"))


@query(
    "log_features",
    """
select application_id, round(ln(1 + greatest(loan_amount, 0)), 6) as loan_amount_log1p,
  round(case when cash is not null then ln(1 + greatest(cash, 0)) end, 6) as cash_log1p
from (select application_id, loan_amount, monthly_income - 2000 as cash from {panel} x) y""",
)
def log_features(v: Views) -> DataFrame:
    df = v.panel.withColumn("cash", F.col("monthly_income") - 2000)
    f = build_features(df, FeatureSpec.empty(log_features=["loan_amount", "cash"]), families=("logs",))
    return out(f, "loan_amount_log1p", "cash_log1p")


@query(
    "winsorize",
    """
with q as (select quantile_cont(loan_amount, 0.01) as l1, quantile_cont(loan_amount, 0.99) as h1,
                  quantile_cont(monthly_income, 0.05) as l2, quantile_cont(monthly_income, 0.9) as h2 from {panel} x)
select application_id, round(least(greatest(loan_amount, l1), h1), 6) as loan_amount_winsor,
  round(case when monthly_income is not null then least(greatest(monthly_income, l2), h2) end, 6) as monthly_income_winsor
from {panel} x, q""",
)
def winsorize(v: Views) -> DataFrame:
    f = panel_features(v, "winsorized", winsorize={"loan_amount": [0.01, 0.99], "monthly_income": [0.05, 0.9]})
    return out(f, "loan_amount_winsor", "monthly_income_winsor")


@query(
    "interactions",
    """
select application_id, round(loan_amount * monthly_income, 4) as loan_amount_x_monthly_income,
  round(loan_amount - monthly_income, 6) as loan_amount_minus_monthly_income,
  round(loan_amount / nullif(monthly_income, 0), 6) as loan_amount_div_monthly_income
from {panel} x""",
)
def interactions(v: Views) -> DataFrame:
    f = panel_features(v, "interactions", interaction_pairs=[["loan_amount", "monthly_income"]])
    n = "loan_amount_{}_monthly_income"
    return f.select(
        "application_id",
        F.round(n.format("x"), 4).alias(n.format("x")),
        F.round(n.format("minus"), 6).alias(n.format("minus")),
        F.round(n.format("div"), 6).alias(n.format("div")),
    )


CLOCK = """
  round(sin(2 * pi() * application_hour / 24), 6) + 0 as application_hour_sin,
  round(cos(2 * pi() * application_hour / 24), 6) + 0 as application_hour_cos,
  cast(coalesce(application_hour >= 21 or application_hour <= 6, false) as int) as is_night,
  cast(coalesce(application_day_of_week in (5, 6), false) as int) as is_weekend,
  round(sin(2 * pi() * application_day_of_week / 7), 6) + 0 as application_dow_sin,
  round(cos(2 * pi() * application_day_of_week / 7), 6) + 0 as application_dow_cos"""


@query("time_features", "select application_id, " + CLOCK + " from {applicant} a")
def time_features(v: Views) -> DataFrame:
    f = build_features(v.applicant, FeatureSpec.empty(), families=("clock",))
    waves = ["application_hour_sin", "application_hour_cos", "application_dow_sin", "application_dow_cos"]
    # Adding zero turns a rounded -0.0 into 0.0.
    return f.select(
        "application_id", *[(F.round(w, 6) + 0).alias(w) for w in waves], "is_night", "is_weekend"
    )


DETECTION_SQL = """
with q as (
  select quantile_cont(annual_income, 0.3) as q30,
         median(coalesce(num_customer_service_calls, 0)) as ms, median(coalesce(num_login_sessions, 0)) as ml
  from {applicant} a
), x as (
  select a.*, q.*, coalesce(num_delinquencies, 0) as dl, debt_to_income_ratio as dti, coalesce(credit_utilization, 0) as ut
  from {applicant} a, q
)
select application_id,
  cast(coalesce(credit_score < 600 and dti > 0.5 and dl > 0, false) as int) as extreme_risk_combo,
  cast(coalesce(credit_score < 650 and dti > 0.43, false) as int) as critical_risk_combo,
  cast(coalesce(dti > 0.6 and annual_income < q30, false) as int) as high_debt_low_income,
  cast(coalesce(age < 30 and ut > 0.8, false) as int) as young_high_utilization,
  cast(coalesce(employment_length < 2 and dti > 0.5, false) as int) as unstable_employment_high_debt,
  cast(coalesce(credit_score < 650, false) as int) * 3 + cast(coalesce(dti > 0.5, false) as int) * 3
    + cast(dl > 0 as int) * 2 + cast(ut > 0.7 as int) * 2 as default_risk_score,
  round(dl * dti, 6) as credit_history_debt_stress,
  round(ut * dti, 6) as utilization_debt_product,
  cast((40 - least(greatest(age, 20), 40)) * (750 - least(greatest(credit_score, 300), 750)) as double) as age_score_interaction,
  cast(monthly_free_cash_flow < 0 as int) as negative_cash_flow,
  cast(monthly_free_cash_flow < -500 as int) as severe_cash_deficit,
  cast(coalesce(dti > 0.85, false) as int) as extreme_dti,
  cast(coalesce(dti > 0.6 and dti <= 0.85, false) as int) as dti_danger_zone,
  cast(num_customer_service_calls > ms * 1.5 and num_login_sessions < ml * 0.5 as int) as support_intensive_low_engagement,
  cast(coalesce(regional_unemployment_rate > 0.08 and annual_income < regional_median_income, false) as int) as regional_economic_stress,
  cast(coalesce(age < 30 and employment_length < 2 and dti > 0.5, false) as int) as triple_risk_young_unstable_debt,
  cast(dl > 1 and num_collections > 0 as int) as credit_history_ruined,
  cast(dl + num_collections * 2 as double) as delinquency_collection_severity,
  cast(ut > 0.95 as int) as maxed_out_credit
from x"""


@query("default_detection", DETECTION_SQL)
def default_detection(v: Views) -> DataFrame:
    df = v.applicant
    rules = detection_features(df)
    exact = {"credit_history_debt_stress", "utilization_debt_product"}
    return df.select("application_id", *[(F.round(c, 6) if n in exact else c).alias(n) for n, c in rules.items()])


@query(
    "smart_interactions",
    "select application_id, "
    + ", ".join(
        f"round({a} * {b}, 4) as ix_{a}_x_{b}, round({a} / nullif({b}, 0), 9) as ix_{a}_div_{b}, round({b} / nullif({a}, 0), 9) as ix_{b}_div_{a}, "
        f"round({a} - {b}, 4) as ix_{a}_minus_{b}, round({b} - {a}, 4) as ix_{b}_minus_{a}"
        for a, b in [("loan_amount", "monthly_income"), ("loan_amount", "age"), ("monthly_income", "age")]
    )
    + " from (select application_id, loan_amount, monthly_income, cast(age as double) as age from {panel} x) y",
)
def smart_interactions_query(v: Views) -> DataFrame:
    df = v.panel
    cols = smart_interactions(df, ["loan_amount", "monthly_income", "age"], max_pairs=20)
    return df.select(
        "application_id",
        *[F.round(c, 4 if "_x_" in n or "_minus_" in n else 9).alias(n) for n, c in cols.items()],
    )


@query(
    "feature_factory",
    """
with q as (select quantile_cont(loan_amount, 0.01) as l1, quantile_cont(loan_amount, 0.99) as h1 from {applicant} x join {panel} using (application_id)),
b as (select a.*, p.loan_amount, p.monthly_income, p.employment_type, p.account_status from {applicant} a join {panel} p using (application_id)),
o as (
  select b.*, l1, h1,
    count(*) over w as n_rows, first_value(loan_amount) over w as f1, last_value(loan_amount) over w as e1,
    stddev_samp(loan_amount) over w as sd, avg(loan_amount) over w as mu,
    avg(loan_amount) over (partition by customer_ref order by application_date, application_id rows between 2 preceding and current row) as roll3,
    avg(monthly_income) over (partition by employment_type) as seg,
    sum(case when lower(account_status) in ('active', 'current', 'open', '1', 'true') then 1 else 0 end) over w as act,
    max(application_date) over w as last_date, max(case when default_flag > 0 then application_date end) over w as last_bad
  from b, q
  window w as (partition by customer_ref order by application_date, application_id rows between unbounded preceding and unbounded following)
)
select application_id,
  round(loan_amount / nullif(monthly_income, 0), 6) as loan_to_income,
  round(mu, 7) as loan_amount_mean_by_customer_ref,
  round(roll3, 7) as loan_amount_roll_mean_3,
  round(case when n_rows > 1 then e1 - f1 else 0 end, 6) as loan_amount_delta,
  cast(coalesce(default_flag, 0) as double) as delinq_sum,
  cast(credit_utilization >= 0.85 as int) as event_high_utilization,
  cast(num_login_sessions >= 8 as int) as behavior_digital_engagement,
  round(monthly_income / (seg + cast(0.000001 as double)), 6) as monthly_income_vs_employment_type,
  round(coalesce(sd, 0) / nullif(mu, 0), 6) as loan_amount_cv,
  cast(date_sub('day', last_bad, last_date) as bigint) as time_since_default_flag,
  cast(act as bigint) as active_loans_count,
  cast(coalesce(application_hour >= 21 or application_hour <= 6, false) as int) as is_night,
  round(ln(1 + greatest(loan_amount, 0)), 6) as loan_amount_log1p,
  round(least(greatest(loan_amount, l1), h1), 6) as loan_amount_winsor,
  round(loan_amount - monthly_income, 6) as loan_amount_minus_monthly_income,
  cast(coalesce(debt_to_income_ratio > 0.85, false) as int) as extreme_dti
from o""",
)
def feature_factory(v: Views) -> DataFrame:
    extra = v.panel.select("application_id", "loan_amount", "monthly_income", "employment_type", "account_status")
    df = v.applicant.join(extra, "application_id")
    spec = FeatureSpec.empty(
        ratios={"loan_to_income": ["loan_amount", "monthly_income"]},
        numeric_aggregations={"loan_amount": ["mean"]},
        rolling_windows=[3],
        trend_features=["loan_amount"],
        delinquency_markers=["default_flag"],
        event_markers={"high_utilization": EventMarker("credit_utilization", 0.85)},
        behavioral_flags={"digital_engagement": BehavioralFlag("num_login_sessions", 8.0)},
        segment_normalization={"monthly_income": "employment_type"},
        volatility_features=["loan_amount"],
        time_since_event_cols=["default_flag"],
        active_loan_indicator="account_status",
        log_features=["loan_amount"],
        winsorize={"loan_amount": [0.01, 0.99]},
        interaction_pairs=[["loan_amount", "monthly_income"]],
    )
    f = build_features(df, spec, date="application_date", entity="customer_ref", tiebreak=TB, detection=True)
    six = [
        "loan_to_income",
        "loan_amount_delta",
        "monthly_income_vs_employment_type",
        "loan_amount_cv",
        "loan_amount_log1p",
        "loan_amount_winsor",
        "loan_amount_minus_monthly_income",
    ]
    seven = ["loan_amount_mean_by_customer_ref", "loan_amount_roll_mean_3"]
    plain = ["delinq_sum", "event_high_utilization", "behavior_digital_engagement", "is_night", "extreme_dti"]
    return f.select(
        "application_id",
        *[F.round(c, 6).alias(c) for c in six],
        *[F.round(c, 7).alias(c) for c in seven],
        *plain,
        *[F.col(c).cast("bigint").alias(c) for c in ("time_since_default_flag", "active_loans_count")],
    )
