"""Score metrics, scorecard, drift, fairness, splits and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scorecard import PointsScale
from creditloom.operators import metrics as M
from creditloom.operators.drift import psi
from creditloom.operators.fairness import fairness_report
from creditloom.operators import splits as X
from creditloom.plans.ranked import average_rank, value_table
from creditloom.workload.base import VIEW_SQL, Views, query

TRAIN_END, VALID_END = "1998-12-31", "2000-06-30"

VIEW_SQL["splits"] = f"""
select *, case when application_date <= timestamp '{TRAIN_END}' then 'train' when application_date <= timestamp '{VALID_END}' then 'valid' else 'oot' end as split
from {{panel}} x"""
VIEW_SQL["group_scores"] = """
select s.application_id, s.y, s.p, d.region, d.employment_type, case when d.age >= 60 then 1 else 0 end as senior
from {scored} s left join {demographics} d on s.customer_ref = d.customer_ref"""


# One row per distinct score with cumulative counts, for every metric check.
CURVE = """
with g as (select p, count(*) as n, cast(sum(y) as bigint) as pos from {scored} s group by p),
c as (select p, n, pos, n - pos as neg, sum(n) over o as cn, sum(pos) over o as cp, sum(n) over () as t, sum(pos) over () as pt from g
  window o as (order by p rows between unbounded preceding and current row))
"""
AUC = "sum(pos * ((cn - cp - neg) + neg / cast(2 as double))) / (max(pt) * cast(max(t - pt) as double))"
AP = "sum(pos * (pt - cp + pos) / cast(t - cn + n as double)) / max(pt)"
KS = "max(abs(cp / cast(pt as double) - (cn - cp) / cast(t - pt as double)))"
LOGLOSS = "avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))))"
BRIER = "avg((p - y) * (p - y))"
EDGES = "[" + ", ".join(f"{e!r}e0" for e in M.unit_edges(10)) + "]"
BINNED = f", b as (select y, p, len(list_filter({EDGES}, lambda e: e <= p)) - 1 as bin from {{scored}} s)"
ECE = "(select sum(w) from (select count(*) / cast((select count(*) from {scored} s) as double) * abs(avg(cast(y as double)) - avg(p)) as w from b where bin between 0 and 9 group by bin))"


@query(
    "ks_curve",
    CURVE + "select p as score, round(cp / cast(pt as double), 9) as cum_bad, round((cn - cp) / cast(t - pt as double), 9) as cum_good from c",
)
def ks_curve(v: Views) -> DataFrame:
    k = M.ks_curve(v.scored)
    return k.select("score", F.round("cum_bad", 9).alias("cum_bad"), F.round("cum_good", 9).alias("cum_good"))


@query("avg_rank", CURVE + "select p as value, cast(n as bigint) as n, cast(cn - n + (n + 1) / cast(2 as double) as double) as avg_rank, round((cn - n + (n + 1) / cast(2 as double)) / t, 9) as pct_rank from c")
def avg_rank(v: Views) -> DataFrame:
    t = value_table(v.scored, ["p"])
    return t.select("value", "n", average_rank().alias("avg_rank"), F.round(average_rank() / F.col("total"), 9).alias("pct_rank"))


def _metric(v: Views, name: str) -> DataFrame:
    return M.ordered_metrics(v.scored).select(F.round(name, 9).alias(name))


@query("metric_auc", CURVE + f"select round({AUC}, 9) as roc_auc, round(2 * {AUC} - 1, 9) as gini from c")
def metric_auc(v: Views) -> DataFrame:
    return M.ordered_metrics(v.scored).select(F.round("roc_auc", 9).alias("roc_auc"), F.round("gini", 9).alias("gini"))


@query("metric_ap", CURVE + f"select round({AP}, 9) as pr_auc from c")
def metric_ap(v: Views) -> DataFrame:
    return _metric(v, "pr_auc")


@query("metric_ks", CURVE + f"select round({KS}, 9) as ks from c")
def metric_ks(v: Views) -> DataFrame:
    return _metric(v, "ks")


@query("metric_logloss", f"select round({LOGLOSS}, 9) as logloss from {{scored}} s")
def metric_logloss(v: Views) -> DataFrame:
    return v.scored.agg(F.round(F.avg(M.log_loss(F.col("y"), F.col("p"))), 9).alias("logloss"))


@query("metric_brier", f"select round({BRIER}, 9) as brier from {{scored}} s")
def metric_brier(v: Views) -> DataFrame:
    return v.scored.agg(F.round(F.avg(M.brier(F.col("y"), F.col("p"))), 9).alias("brier"))


@query("metric_ece", "with z as (select 1)" + BINNED + f" select round({ECE}, 9) as ece")
def metric_ece(v: Views) -> DataFrame:
    y, p = F.col("y").cast("double"), F.col("p")
    return v.scored.agg(F.round(M.calibration_error_aggs(y, p, 10), 9).alias("ece"))


@query(
    "reliability",
    "with z as (select 1)"
    + BINNED
    + " select cast(bin as int) as bin, cast(count(*) as bigint) as n, round(avg(cast(y as double)), 9) as mean_true, round(avg(p), 9) as mean_pred from b where bin between 0 and 9 group by bin",
)
def reliability(v: Views) -> DataFrame:
    r = M.reliability(v.scored)
    return r.select("bin", "n", F.round("mean_true", 9).alias("mean_true"), F.round("mean_pred", 9).alias("mean_pred"))


LIFT = """
select cast(k as int) as point, cast(k * step as bigint) as depth,
  round((pt - cp + (k * step - (t - cn)) / cast(n as double) * pos) / (k * step), 9) as gain,
  round((pt - cp + (k * step - (t - cn)) / cast(n as double) * pos) / (k * step) / (pt / cast(t as double) + cast(0.000001 as double)), 9) as lift
from (select *, greatest(t // 10, 1) as step from c) join unnest(range(1, 11)) r(k) on k * step > t - cn and k * step <= t - cn + n"""


@query("lift_curve", CURVE + LIFT)
def lift_curve(v: Views) -> DataFrame:
    c = M.lift_curve(v.scored)
    return c.select("point", "depth", F.round("gain", 9).alias("gain"), F.round("lift", 9).alias("lift"))


@query(
    "metric_report",
    CURVE
    + BINNED
    + f"""select round({AUC}, 9) as roc_auc, round(2 * {AUC} - 1, 9) as gini, round({AP}, 9) as pr_auc, round({KS}, 9) as ks,
  (select round({LOGLOSS}, 9) from {{scored}} s) as logloss, (select round({BRIER}, 9) from {{scored}} s) as brier, round(any_value({ECE}), 9) as ece from c""",
)
def metric_report(v: Views) -> DataFrame:
    r = M.metric_report(v.scored)
    return r.select(*[F.round(m, 9).alias(m) for m in M.METRICS])


def _f(b: int) -> str:
    b2 = b * b
    pr, rc = "((pt - cp + pos) / cast(t - cn + n as double))", "((pt - cp + pos) / cast(pt as double))"
    plain = f"({1 + b2} * (pt - cp + pos)) / cast({1 + b2} * (pt - cp + pos) + {b2} * (cp - pos) + (t - cn + n - (pt - cp + pos)) as double)"
    curve = f"{1 + b2} * {pr} * {rc} / ({b2} * {pr} + {rc} + cast(0.000001 as double))"
    return f"select 'f{b}' as metric, p as threshold, round({plain}, 9) as f_score from c order by round({curve}, 12) desc, p limit 1"


@query("best_threshold", CURVE + f"(select * from ({_f(1)})) union all (select * from ({_f(2)}))")
def best_threshold(v: Views) -> DataFrame:
    return M.best_thresholds(v.scored).withColumn("f_score", F.round("f_score", 9))


CFG = PointsScale()
EVEN, SLOPE = CFG.line()


@query(
    "pd_to_score",
    f"""select application_id, round(least(greatest({EVEN!r}e0 + {SLOPE!r}e0 * ln((1 - q) / q), 300), 900), 6) as score
from (select application_id, least(greatest(p, 1e-6), 1 - 1e-6) as q from {{scored}} s)""",
)
def pd_to_score_query(v: Views) -> DataFrame:
    return v.scored.select("application_id", F.round(CFG.points(F.col("p")), 6).alias("score"))


@query(
    "score_to_pd",
    f"select application_id, round(1 / (1 + exp((300 + 600 * p - {EVEN!r}e0) / {SLOPE!r}e0)), 9) as pd from {{scored}} s",
)
def score_to_pd_query(v: Views) -> DataFrame:
    return v.scored.select("application_id", F.round(CFG.probability(300 + 600 * F.col("p")), 9).alias("pd"))


PSI_COLS = ["loan_amount", "monthly_income", "age"]


def _psi_sql(others: list[str], shared: bool, columns: list[str] = PSI_COLS, view: str = "splits") -> str:
    long = "\nunion all\n".join(f"select split, '{c}' as feature, cast({c} as double) as x from {{{view}}} s where {c} is not null" for c in columns)
    lo = "min(x) over (partition by feature, split)" if not shared else "min(case when split = 'train' then x end) over (partition by feature)"
    hi = lo.replace("min(", "max(")
    x = "least(greatest(x, lo), hi)" if shared else "x"
    one = """select 'train_{o}' as pair, feature, round(sum((a - e) * ln((a + cast(0.000001 as double)) / (e + cast(0.000001 as double)))), 9) as psi from (
  select feature, bin, coalesce(max(case when split = '{o}' then s end), 0) as a, coalesce(max(case when split = 'train' then s end), 0) as e from q group by feature, bin) group by feature"""
    return f"""
with lg as ({long}), r as (select *, {lo} as lo, {hi} as hi from lg),
h as (select feature, split, least(cast(floor(({x} - lo) / (hi - lo) * 10) as bigint), 9) as bin, count(*) as n from r group by 1, 2, 3),
q as (select feature, split, bin, n / cast(sum(n) over (partition by feature, split) as double) as s from h)
""" + "\nunion all\n".join(one.format(o=o) for o in others)


@query("psi_own_range", _psi_sql(["valid"], False))
def psi_own_range(v: Views) -> DataFrame:
    return psi(v.splits, "split", "train", ["valid"], PSI_COLS).withColumn("psi", F.round("psi", 9))


@query("psi_shared", _psi_sql(["valid"], True))
def psi_shared(v: Views) -> DataFrame:
    return psi(v.splits, "split", "train", ["valid"], PSI_COLS, shared_bins=True).withColumn("psi", F.round("psi", 9))


@query("psi_report", _psi_sql(["valid", "oot"], False))
def psi_report(v: Views) -> DataFrame:
    return psi(v.splits, "split", "train", ["valid", "oot"], PSI_COLS).withColumn("psi", F.round("psi", 9))


FAIR = "\nunion all\n".join(
    f"select '{c}' as attribute, cast({c} as varchar) as grp, y, p, 300 + 600 * p as s from {{group_scores}} g where {c} is not null"
    for c in ("region", "employment_type", "senior")
)


@query(
    "fairness_report",
    f"""
with lg as ({FAIR}),
sz as (select attribute, grp, cast(count(*) as bigint) as n, avg(cast(y as double)) as bad_rate, avg(s) as avg_score from lg group by 1, 2 having count(*) >= 50),
g as (select attribute, grp, p, count(*) as n, cast(sum(y) as bigint) as pos from lg group by 1, 2, 3),
c as (select *, n - pos as neg, sum(n - pos) over (partition by attribute, grp order by p rows between unbounded preceding and current row) as cneg,
  sum(pos) over (partition by attribute, grp) as pt, sum(n - pos) over (partition by attribute, grp) as nt from g),
a as (select attribute, grp, sum(pos * (cneg - neg + neg / cast(2 as double))) / nullif(max(pt) * cast(max(nt) as double), 0) as auc from c group by 1, 2)
select sz.attribute, sz.grp as "group", n as count, round(bad_rate, 9) as bad_rate, round(auc, 9) as auc, round(avg_score, 6) as avg_score
from sz left join a on sz.attribute = a.attribute and sz.grp = a.grp""",
)
def fairness(v: Views) -> DataFrame:
    df = v.group_scores.withColumn("s", 300 + 600 * F.col("p"))
    r = fairness_report(df, ["region", "employment_type", "senior"], "y", "p", "s")
    return r.select(
        "attribute", "group", "count", F.round("bad_rate", 9).alias("bad_rate"), F.round("auc", 9).alias("auc"), F.round("avg_score", 6).alias("avg_score")
    )


# -- splits ----------------------------------------------------------------------------------------------


@query("split_by_time", "select application_id, split from {splits} s")
def split_by_time(v: Views) -> DataFrame:
    return X.split_by_time(v.application, "application_date", TRAIN_END, VALID_END, "application_id").select("application_id", "split")


@query(
    "split_quantile",
    """
with o as (select application_id, row_number() over (order by application_date, application_id) - 1 as i, count(*) over () as n from {application} a)
select application_id, case when i < greatest(1, n * 3 // 5) then 'train' when i < n * 4 // 5 then 'valid' else 'oot' end as split from o""",
)
def split_quantile(v: Views) -> DataFrame:
    # The configured ends lie after all dates, so the position fallback decides.
    return X.split_by_time(v.application, "application_date", "2030-12-31", "2031-12-31", "application_id").select("application_id", "split")


@query(
    "split_summary",
    """
select split, cast(count(*) as bigint) as n, round(avg(cast(default_flag as double)), 9) as target_rate, min(application_date) as first_date, max(application_date) as last_date
from {splits} s group by split""",
)
def split_summary(v: Views) -> DataFrame:
    from creditloom.operators.stats import split_summary as summary

    return summary(v.splits, "application_date", "default_flag").withColumn("target_rate", F.round("target_rate", 9))


@query(
    "cv_row_folds",
    """
with o as (select application_id, row_number() over (order by application_date, application_id) - 1 as i, count(*) over () as n from {application} a)
select application_id, cast(case when i < n - 3 * (n // 4) then 0 else (i - (n - 3 * (n // 4))) // (n // 4) + 1 end as int) as block from o""",
)
def cv_row_folds(v: Views) -> DataFrame:
    return X.row_folds(v.application, "application_date", "application_id", 3).select("application_id", "block")


@query(
    "cv_group_folds",
    """
with f as (select customer_ref, min(application_date) as d from {application} a group by customer_ref),
o as (select customer_ref, row_number() over (order by d, customer_ref) - 1 as i, count(*) over () as n from f),
b as (select customer_ref, cast(case when i < n - 3 * (n // 4) then 0 else (i - (n - 3 * (n // 4))) // (n // 4) + 1 end as int) as block from o)
select a.application_id, b.block from {application} a join b on a.customer_ref = b.customer_ref""",
)
def cv_group_folds(v: Views) -> DataFrame:
    return X.group_folds(v.application, "application_date", "customer_ref", 3).select("application_id", "block")


@query("kfold_hash")
def kfold_hash(v: Views) -> DataFrame:
    return v.application.select("application_id", X.hash_fold("application_id", 5).alias("fold"))


@query("hash_sample")
def hash_sample(v: Views) -> DataFrame:
    return X.hash_sample(v.application.select("application_id", "default_flag"), "application_id", 5000)


@query(
    "align_splits",
    """
select cast(null as double) as "age", application_id, default_flag, loan_amount, cast(null as double) as monthly_income, split from {splits} s where split = 'train'
union all
select cast(age as double), application_id, default_flag, loan_amount, null, split from {splits} s where split = 'valid'
union all
select null, application_id, default_flag, loan_amount, monthly_income, split from {splits} s where split = 'oot'""",
)
def align_splits(v: Views) -> DataFrame:
    from creditloom.operators.jobs import align_frames

    base = v.splits.withColumn("age", F.col("age").cast("double"))
    frames = {
        "train": base.filter("split = 'train'").select("application_id", "default_flag", "loan_amount", "split"),
        "valid": base.filter("split = 'valid'").select("application_id", "default_flag", "loan_amount", "age", "split"),
        "oot": base.filter("split = 'oot'").select("monthly_income", "application_id", "default_flag", "loan_amount", "split"),
    }
    return align_frames(frames)
