"""Feature diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import diagnostics as D
from creditloom.plans.session import materialize
from creditloom.workload.base import VIEW_SQL, Views, query
from creditloom.workload import ranking  # noqa: F401  (defines the split view)

# Panel with a weak, a constant, a leaking and a text feature.
VIEW_SQL["probe"] = """
select application_id, split, default_flag, loan_amount, monthly_income, cast(age as double) as age,
       cast(default_flag * 2 + 1 as double) as leak, cast(1 as double) as constant,
       cast(case when application_id % 3 = 0 then null else (application_id * 31) % 17 end as double) as noise,
       loan_purpose, cast(age % 10 as string) as digit
from {splits} s"""

COLS = ["loan_amount", "monthly_income", "age", "leak", "constant", "noise", "loan_purpose", "digit"]

LONG = "\nunion all\n".join(
    f"select split, default_flag as y, '{c}' as feature, "
    + (f"cast(dense_rank() over (partition by split order by {c}) - 1 as double)" if c == "loan_purpose" else f"cast({c} as double)")
    + " as x from {probe} q"
    for c in COLS
)
STATS = f"""
with lg as ({LONG}),
g as (select split, feature, x, count(*) as n, cast(sum(y) as bigint) as pos from lg where x is not null group by 1, 2, 3),
c as (select *, n - pos as neg, sum(n) over o as cn, sum(pos) over o as cp, sum(n) over k as t, sum(pos) over k as pt from g
  window o as (partition by split, feature order by x rows between unbounded preceding and current row), k as (partition by split, feature)),
st as (select split, feature, cast(max(t) as bigint) as n, cast(count(*) as bigint) as distinct_n,
  case when max(t) >= 20 and count(*) >= 2 and max(pt) between 1 and max(t) - 1
    then sum(pos * (cn - cp - neg + neg / cast(2 as double))) / (max(pt) * cast(max(t - pt) as double)) else cast(0.5 as double) end as auc,
  case when max(case when pos > 0 and pos < n then 1 else 0 end) = 0 then 1 else 0 end as deterministic from c group by 1, 2),
rk as (select lg.split, lg.feature, lg.y, cn - n + (n + 1) / cast(2 as double) as r from lg join c on lg.split = c.split and lg.feature = c.feature and lg.x = c.x),
sp as (select split, feature, case when count(*) >= 10 and min(r) < max(r) then corr(r, cast(y as double)) else 0 end as spearman from rk group by 1, 2),
mo as (select split, feature, cast(count(*) as bigint) as n_rows, stddev_samp(x) as std, case when min(x) < max(x) then corr(x, cast(y as double)) else 0 end as corr from lg group by 1, 2)
"""


def splits(v: Views) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows from one written table: the checks read it several times."""
    table = materialize(v.probe.select("split", "default_flag", *COLS), "probe")
    return table.filter("split = 'train'"), table.filter("split = 'valid'")


def encoded(v: Views) -> DataFrame:
    return D.encode_for_diagnostics(splits(v)[0], COLS, ["default_flag"])


@query("feature_auc", STATS + "select feature, n, round(auc, 9) as auc from st where split = 'train'")
def feature_auc(v: Views) -> DataFrame:
    s = D.feature_stats(encoded(v), COLS, "default_flag")
    return s.select("feature", "n", F.round("auc", 9).alias("auc"))


@query("feature_corr", STATS + "select feature, round(corr, 9) as corr from mo where split = 'train'")
def feature_corr(v: Views) -> DataFrame:
    return D.feature_moments(encoded(v), COLS, "default_flag").select("feature", F.round("corr", 9).alias("corr"))


@query("feature_spearman", STATS + "select feature, round(spearman, 9) as spearman from sp where split = 'train'")
def feature_spearman(v: Views) -> DataFrame:
    s = D.feature_stats(encoded(v), COLS, "default_flag")
    return s.select("feature", F.round("spearman", 9).alias("spearman"))


@query(
    "low_variance",
    STATS
    + """select mo.feature, round(distinct_n / cast(n_rows as double), 9) as unique_ratio, cast(distinct_n / cast(n_rows as double) <= 0.001 or std = 0 as int) as low_variance
from mo join st using (split, feature) where split = 'train'""",
)
def low_variance(v: Views) -> DataFrame:
    d = D.diagnose(splits(v)[0], None, COLS, "default_flag")
    return d.select("feature", F.round("unique_ratio", 9).alias("unique_ratio"), "low_variance")


@query("deterministic_map", STATS + "select feature, cast(deterministic as int) as deterministic from st where split = 'train'")
def deterministic_map(v: Views) -> DataFrame:
    return D.feature_stats(encoded(v), COLS, "default_flag").select("feature", "deterministic")


VERDICT = STATS + """, va as (select feature, auc as auc_valid from st where split = 'valid'),
j as (select mo.feature, st.auc as auc_train, va.auc_valid, mo.corr, sp.spearman, distinct_n / cast(n_rows as double) as ur, std, deterministic
  from mo join st using (split, feature) join sp using (split, feature) left join va on va.feature = mo.feature where split = 'train'),
f as (select *, ur <= 0.001 or std = 0 as lv, auc_train >= 0.98 or coalesce(auc_valid >= 0.98, false) or deterministic = 1 as su,
  abs(auc_train - 0.5) <= 0.02 and coalesce(abs(auc_valid - 0.5) <= 0.02, true) as we, abs(spearman) < 0.01 as ws from j)
"""


@query(
    "feature_diagnostics",
    VERDICT
    + """select feature, round(auc_train, 9) as auc_train, round(auc_valid, 9) as auc_valid, round(corr, 9) as corr, round(spearman, 9) as spearman,
  round(ur, 9) as unique_ratio, cast(lv as int) as low_variance, cast(su as int) as suspicious, cast(we as int) as weak_auc, cast(ws as int) as weak_spearman,
  cast(lv or su or we or ws as int) as "drop" from f""",
)
def feature_diagnostics(v: Views) -> DataFrame:
    cfg = D.SelectionConfig(drop_weak=True, drop_weak_spearman=True)
    d = D.diagnose(*splits(v), COLS, "default_flag", cfg)
    real = ("auc_train", "auc_valid", "corr", "spearman", "unique_ratio")
    return d.select(*[F.round(c, 9).alias(c) if c in real else F.col(c) for c in d.columns])


@query(
    "topk_features",
    STATS + "select feature, round(spearman, 9) as spearman from sp where split = 'train' order by abs(spearman) desc, feature limit 4",
)
def topk_features(v: Views) -> DataFrame:
    s = D.feature_stats(encoded(v), COLS, "default_flag").select("feature", "spearman")
    return D.top_features(s, "spearman", 4, absolute=True).withColumn("spearman", F.round("spearman", 9))
