"""History queries: trailing windows per application and summaries per customer."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import history as H
from creditloom.workload.base import Views, query

CFG = H.HistoryConfig(tiebreak=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
NUMERIC = ["revolving_balance", "payment_amount", "min_payment", "due_amount", "credit_limit", "dpd"]
WINDOWS = (3, 6, 12)


def rounded(df: DataFrame, keys: list[str], digits: dict[str, int], ints: list[str] = ()) -> DataFrame:
    return df.select(
        *keys,
        *[F.round(F.col(c), d).alias(c) for c, d in digits.items()],
        *[F.col(c).cast("bigint").alias(c) for c in ints],
    )


def features(v: Views, only: list[str], cfg: H.HistoryConfig = CFG) -> DataFrame:
    return H.history_features(v.history, v.application, cfg, only)


# The check's own point-in-time rows: every application with its statements and their order.
PIT = """
with pit as (
  select a.application_id, a.application_date, h.*
  from {application} a join {history} h
    on a.customer_ref = h.customer_ref
   and h.statement_date <= a.application_date
   and h.statement_date >= a.application_date - interval 12 month
), p as (
  select *,
    statement_date >= application_date - interval 3 month as in3,
    statement_date >= application_date - interval 6 month as in6,
    true as in12,
    revolving_balance / nullif(credit_limit, 0) as util,
    coalesce(revolving_balance / nullif(credit_limit, 0), 0) as util0,
    nullif(payment_amount, 0) as payz,
    payment_amount / nullif(revolving_balance, 0) as p2d,
    (statement_date, l_orderkey, l_linenumber, l_partkey, l_suppkey) as ord
  from pit
)
"""


def per_window(template: str, windows=WINDOWS) -> str:
    return ",\n".join(template.replace("@", str(k)) for k in windows)


@query(
    "pit_join",
    PIT
    + """
select a.application_id, cast(count(p.application_id) as bigint) as n_statements,
       min(p.statement_date) as first_date, max(p.statement_date) as last_date
from {application} a left join p on a.application_id = p.application_id
group by a.application_id""",
)
def pit_join(v: Views) -> DataFrame:
    f = features(v, ["credit_history_records", "history_first_date", "history_last_date"])
    return f.select(
        "application_id",
        F.coalesce("credit_history_records", F.lit(0)).cast("bigint").alias("n_statements"),
        F.col("history_first_date").alias("first_date"),
        F.col("history_last_date").alias("last_date"),
    )


BASIC = per_window("""
  cast(nullif(count(*) filter (in@), 0) as bigint) as credit_history_records_@m,
  cast(max(dpd) filter (in@) as double) as dpd_max_@m,
  round(avg(dpd) filter (in@), 6) as dpd_mean_@m,
  cast(sum(case when dpd > 0 then 1 else 0 end) filter (in@) as bigint) as num_late_payments_@m,
  round(avg(util) filter (in@), 10) as utilization_avg_@m,
  round(max(util) filter (in@), 6) as utilization_max_@m,
  round(avg(p2d) filter (in@), 6) as payment_to_debt_ratio_@m""")


@query(
    "hist_window_basic",
    PIT
    + ", f as (select application_id,"
    + BASIC
    + """,
  round(case when count(revolving_balance) filter (in6) >= 2
       then arg_max(revolving_balance, ord) filter (in6) - arg_min(revolving_balance, ord) filter (in6)
       when count(revolving_balance) filter (in6) >= 1 then 0 end, 4) as trend_balance_6m,
  round(stddev_pop(payment_amount) filter (in6), 4) as volatility_payments_6m
  from p group by application_id)
select a.application_id, f.* exclude (application_id)
from {application} a left join f on a.application_id = f.application_id""",
)
def hist_window_basic(v: Views) -> DataFrame:
    digits, ints = {}, []
    for k in WINDOWS:
        ints += [f"credit_history_records_{k}m", f"num_late_payments_{k}m"]
        digits |= {
            f"dpd_max_{k}m": 6,
            f"dpd_mean_{k}m": 6,
            f"utilization_avg_{k}m": 10,
            f"utilization_max_{k}m": 6,
            f"payment_to_debt_ratio_{k}m": 6,
        }
    digits |= {"trend_balance_6m": 4, "volatility_payments_6m": 4}
    return rounded(features(v, [*digits, *ints]), ["application_id"], digits, ints)


@query(
    "hist_numeric_aggs",
    PIT
    + "select a.application_id,"
    + ",\n".join(
        f"round(avg(p.{c}), 7) as {c}_mean_hist, cast(max(p.{c}) as double) as {c}_max_hist, "
        f"cast(min(p.{c}) as double) as {c}_min_hist"
        for c in NUMERIC
    )
    + "\nfrom {application} a left join p on a.application_id = p.application_id group by a.application_id",
)
def hist_numeric_aggs(v: Views) -> DataFrame:
    names = [f"{c}_{s}_hist" for c in NUMERIC for s in ("mean", "max", "min")]
    f = features(v, names, replace(CFG, numeric=NUMERIC))
    return f.select(
        "application_id",
        *[F.round(f"{c}_mean_hist", 7).alias(f"{c}_mean_hist") for c in NUMERIC],
        *[f"{c}_{s}_hist" for c in NUMERIC for s in ("max", "min")],
    )


@query(
    "hist_record_count",
    PIT
    + """
select a.application_id, cast(nullif(count(p.application_id), 0) as bigint) as credit_history_records
from {application} a left join p on a.application_id = p.application_id group by a.application_id""",
)
def hist_record_count(v: Views) -> DataFrame:
    return features(v, ["credit_history_records"]).select("application_id", F.col("credit_history_records").cast("bigint").alias("credit_history_records"))


@query(
    "hist_flag_stats",
    PIT
    + "select a.application_id,"
    + ",\n".join(
        f"cast(sum(case when p.application_id is null then null when p.dpd >= {t} then 1 else 0 end) as bigint) as dpd_{t}_flag_sum_hist, "
        f"round(avg(case when p.application_id is null then null when p.dpd >= {t} then 1 else 0 end), 6) as dpd_{t}_flag_rate_hist, "
        f"cast(max(case when p.application_id is null then null when p.dpd >= {t} then 1 else 0 end) as int) as dpd_{t}_flag_max_hist"
        for t in CFG.dpd_thresholds
    )
    + "\nfrom {application} a left join p on a.application_id = p.application_id group by a.application_id",
)
def hist_flag_stats(v: Views) -> DataFrame:
    flagged = v.history.select(
        "*", *[F.when(F.col("dpd") >= t, 1).otherwise(0).alias(f"dpd_{t}_flag") for t in CFG.dpd_thresholds]
    )
    names = [f"dpd_{t}_flag_{s}_hist" for t in CFG.dpd_thresholds for s in ("sum", "rate", "max")]
    f = H.history_features(flagged, v.application, CFG, names)
    out = ["application_id"]
    for t in CFG.dpd_thresholds:
        c = f"dpd_{t}_flag"
        out += [
            F.col(f"{c}_sum_hist").cast("bigint").alias(f"{c}_sum_hist"),
            F.round(f"{c}_rate_hist", 6).alias(f"{c}_rate_hist"),
            F.col(f"{c}_max_hist").cast("int").alias(f"{c}_max_hist"),
        ]
    return f.select(*out)


@query(
    "beh_dpd",
    PIT
    + ", f as (select application_id,"
    + per_window("""
  cast(sum(case when dpd > 0 then 1 else 0 end) filter (in@) as bigint) as beh_dpd_cnt_gt0_@m,
  cast(sum(case when dpd >= 30 then 1 else 0 end) filter (in@) as bigint) as beh_dpd_cnt_ge30_@m,
  cast(sum(case when dpd >= 60 then 1 else 0 end) filter (in@) as bigint) as beh_dpd_cnt_ge60_@m,
  cast(max(coalesce(dpd, 0)) filter (in@) as double) as beh_dpd_max_@m,
  round(avg(case when dpd > 0 then 1 else 0 end) filter (in@), 6) as beh_dpd_rate_@m""")
    + """
  from p group by application_id)
select a.application_id, f.* exclude (application_id)
from {application} a left join f on a.application_id = f.application_id""",
)
def beh_dpd(v: Views) -> DataFrame:
    digits, ints = {}, []
    for k in WINDOWS:
        ints += [f"beh_dpd_cnt_{s}_{k}m" for s in ("gt0", "ge30", "ge60")]
        digits |= {f"beh_dpd_max_{k}m": 6, f"beh_dpd_rate_{k}m": 6}
    return rounded(features(v, [*digits, *ints]), ["application_id"], digits, ints)


@query(
    "beh_recovery",
    PIT
    + """, s as (
  select application_id, case when dpd > 0 then 1 else 0 end as was,
         lag(case when dpd > 0 then 1 else 0 end, 1, 0) over (partition by application_id order by ord) as prev
  from p
), f as (
  select application_id, cast(sum(case when was = 0 and prev = 1 then 1 else 0 end) as bigint) as beh_recovery_episodes_12m
  from s group by application_id)
select a.application_id, f.beh_recovery_episodes_12m
from {application} a left join f on a.application_id = f.application_id""",
)
def beh_recovery(v: Views) -> DataFrame:
    names = ["beh_recovery_episodes_12m"]
    return rounded(features(v, names), ["application_id"], {}, names)


def _slope_sql(k: int, x: str, name: str) -> str:
    return f"""(select application_id, round(case when count(*) < 2 then 0 else regr_slope(y, i) end, {9 if "util" in name else 7}) as {name} from (
  select application_id, {x} as y, row_number() over (partition by application_id order by ord) - 1 as i
  from p where in{k} and {x} is not null) group by application_id)"""


SLOPES = [
    (6, "revolving_balance", "beh_balance_slope_6m"),
    (12, "revolving_balance", "beh_balance_slope_12m"),
    (12, "payz", "beh_payment_slope_12m"),
    (6, "util0", "beh_util_slope_6m"),
    (12, "util0", "beh_util_slope_12m"),
]


@query(
    "beh_slopes",
    PIT
    + "select a.application_id, "
    + ", ".join(f"s{i}.{n}" for i, (_, _, n) in enumerate(SLOPES))
    + " from {application} a "
    + "\n".join(
        f"left join {_slope_sql(k, x, n)} s{i} on a.application_id = s{i}.application_id"
        for i, (k, x, n) in enumerate(SLOPES)
    ),
)
def beh_slopes(v: Views) -> DataFrame:
    digits = {n: 9 if "util" in n else 7 for _, _, n in SLOPES}
    return rounded(features(v, list(digits)), ["application_id"], digits)


@query(
    "beh_deltas",
    PIT
    + ", f as (select application_id,"
    + per_window("""
  round(arg_max(revolving_balance, ord) filter (in@ and revolving_balance is not null) - avg(revolving_balance) filter (in@), 7) as beh_balance_delta_@m,
  round(arg_max(payment_amount, ord) filter (in@ and payment_amount is not null) - avg(payment_amount) filter (in@), 7) as beh_payment_delta_@m""")
    + """
  from p group by application_id)
select a.application_id, f.* exclude (application_id)
from {application} a left join f on a.application_id = f.application_id""",
)
def beh_deltas(v: Views) -> DataFrame:
    names = [f"beh_{x}_delta_{k}m" for k in WINDOWS for x in ("balance", "payment")]
    return rounded(features(v, names), ["application_id"], {n: 7 for n in names})


def _vol_sql(x: str, label: str) -> str:
    return per_window(f"""
  case when count(*) filter (in@) > 0 then round(coalesce(stddev_pop({x}) filter (in@), 0), 4) end as beh_{label}_std_@m,
  case when count(*) filter (in@) > 0 then round(coalesce(stddev_pop({x}) filter (in@) / nullif(avg({x}) filter (in@), 0), 0), 6) end as beh_{label}_cv_@m""")


@query(
    "beh_volatility",
    PIT
    + ", f as (select application_id,"
    + ",".join([_vol_sql("payment_amount", "payment"), _vol_sql("revolving_balance", "balance"), _vol_sql("util0", "util")])
    + """
  from p group by application_id)
select a.application_id, f.* exclude (application_id)
from {application} a left join f on a.application_id = f.application_id""",
)
def beh_volatility(v: Views) -> DataFrame:
    digits = {}
    for k in WINDOWS:
        for x in ("payment", "balance", "util"):
            digits |= {f"beh_{x}_std_{k}m": 4, f"beh_{x}_cv_{k}m": 6}
    return rounded(features(v, list(digits)), ["application_id"], digits)


@query(
    "beh_underpayment",
    PIT
    + ", f as (select application_id,"
    + per_window("""
  round(avg(case when payment_amount < min_payment then 1 else 0 end) filter (in@), 6) as beh_underpayment_rate_@m""")
    + """
  from p group by application_id)
select a.application_id, f.* exclude (application_id)
from {application} a left join f on a.application_id = f.application_id""",
)
def beh_underpayment(v: Views) -> DataFrame:
    digits = {f"beh_underpayment_rate_{k}m": 6 for k in WINDOWS}
    return rounded(features(v, list(digits)), ["application_id"], digits)


@query(
    "attach_features",
    PIT
    + """, f as (select application_id, cast(count(*) as bigint) as credit_history_records, cast(max(dpd) as double) as dpd_max_12m
  from p group by application_id)
select a.application_id, a.customer_ref, a.loan_amount, a.default_flag, f.credit_history_records, f.dpd_max_12m
from {application} a left join f on a.application_id = f.application_id""",
)
def attach_features(v: Views) -> DataFrame:
    block = features(v, ["credit_history_records", "dpd_max_12m"]).select(
        "application_id", F.col("credit_history_records").cast("bigint").alias("credit_history_records"), "dpd_max_12m"
    )
    apps = v.application.select("application_id", "customer_ref", "loan_amount", "default_flag")
    return H.attach_features(apps, block)


SUMMARY_SQL = """
with s as (
  select customer_ref, statement_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, revolving_balance,
    cast(coalesce(dpd, 0) as double) as dpd_value,
    payment_amount / nullif(due_amount, 0) as payment_ratio,
    revolving_balance / nullif(credit_limit, 0) as utilization,
    (revolving_balance - payment_amount) / nullif(due_amount, 0) as past_due_ratio
  from {history} h
)
"""


@query(
    "hist_summary",
    SUMMARY_SQL
    + "select customer_ref, "
    + ", ".join(
        f"round(avg({x}), 6) as {x}_mean, round(max({x}), 6) as {x}_max, round(stddev_samp({x}), 6) as {x}_std"
        for x in ("dpd_value", "payment_ratio", "utilization", "past_due_ratio")
    )
    + " from s group by customer_ref",
)
def hist_summary(v: Views) -> DataFrame:
    names = [f"{x}_{s}" for x in ("dpd_value", "payment_ratio", "utilization", "past_due_ratio") for s in ("mean", "max", "std")]
    return rounded(H.customer_summary(v.history, CFG), ["customer_ref"], {n: 6 for n in names})


@query(
    "hist_dpd_flags",
    SUMMARY_SQL
    + "select customer_ref, "
    + ", ".join(
        f"cast(sum(case when dpd_value >= {t} then 1 else 0 end) as bigint) as dpd_{t}_flag_count, "
        f"round(avg(case when dpd_value >= {t} then 1 else 0 end), 6) as dpd_{t}_flag_share, "
        f"cast(avg(case when dpd_value >= {t} then 1 else 0 end) > 0.5 as int) as dpd_{t}_flag_chronic"
        for t in CFG.dpd_thresholds
    )
    + " from s group by customer_ref",
)
def hist_dpd_flags(v: Views) -> DataFrame:
    s = H.customer_summary(v.history, CFG)
    out = ["customer_ref"]
    for t in CFG.dpd_thresholds:
        c = f"dpd_{t}_flag"
        out += [
            F.col(f"{c}_count").cast("bigint").alias(f"{c}_count"),
            F.round(f"{c}_share", 6).alias(f"{c}_share"),
            f"{c}_chronic",
        ]
    return s.select(*out)


@query(
    "pit_cutoff",
    """
with cut as (select customer_ref, max(application_date) as cut_date from {application} a group by customer_ref)
select h.customer_ref, cast(count(*) as bigint) as n_rows, max(h.statement_date) as last_date, round(sum(h.revolving_balance), 4) as balance_sum
from {history} h join cut c on h.customer_ref = c.customer_ref
where h.statement_date <= c.cut_date group by h.customer_ref""",
)
def pit_cutoff(v: Views) -> DataFrame:
    kept = H.cut_at_application(v.history, v.application, CFG)
    return kept.groupBy("customer_ref").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("statement_date").alias("last_date"),
        F.round(F.sum("revolving_balance"), 4).alias("balance_sum"),
    )


@query(
    "latest_snapshot",
    SUMMARY_SQL
    + """, r as (
  select *, row_number() over (partition by customer_ref order by statement_date desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc) as rn
  from s)
select customer_ref, statement_date, l_orderkey, l_linenumber, revolving_balance, dpd_value, round(utilization, 6) as utilization
from r where rn = 1""",
)
def latest_snapshot(v: Views) -> DataFrame:
    rows = H.with_summary_inputs(v.history, CFG)
    cols = ["statement_date", "l_orderkey", "l_linenumber", "revolving_balance", "dpd_value", "utilization"]
    last = H.latest_snapshot(rows, "customer_ref", "statement_date", CFG.tiebreak, cols)
    return last.withColumn("utilization", F.round("utilization", 6))
