"""Aggregates, preprocessing, binning and WOE queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import jobs as J
from creditloom.operators import neighbours as N
from creditloom.operators import prep as P
from creditloom.operators import stats as S
from creditloom.operators import woe as W
from creditloom.plans.ranked import exact_quantiles
from creditloom.plans.session import materialize
from creditloom.workload.base import VIEW_SQL, Views, query

NUM = ["loan_amount", "monthly_income", "age"]
CATS = ["loan_purpose", "account_status", "employment_type", "region"]

# Panel with missing, empty and differently cased levels.
VIEW_SQL["messy"] = """
select application_id, customer_ref, application_date, default_flag, loan_amount, monthly_income, cast(age as double) as age,
       case when age = 20 then null when age = 21 then '  ' when age % 3 = 0 then ' ' || upper(region) || ' ' else lower(region) end as region,
       case when application_id % 400 = 0 then 'Rare A' when application_id % 401 = 0 then 'rare b' else loan_purpose end as loan_purpose
from {panel} x"""


def rows_of(df: DataFrame, columns: list[str], digits: int = 6, keys: tuple = ()) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in columns])


@query(
    "quantiles",
    "\nunion all\n".join(
        f"select '{c}' as feature, round(quantile_cont({c}, 0.01), 6) as p01, round(quantile_cont({c}, 0.25), 6) as p25, "
        f"round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.99), 6) as p99 from {{panel}} x"
        for c in NUM
    ),
)
def quantiles(v: Views) -> DataFrame:
    q = exact_quantiles(v.panel, NUM, [0.01, 0.25, 0.5, 0.99])
    return q.select("feature", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(["p01", "p25", "p50", "p99"])])


@query(
    "skew_adjusted",
    """
select employment_type, round(skewness(loan_amount), 6) as skew_loan, round(skewness(monthly_income), 6) as skew_income
from {panel} x group by employment_type""",
)
def skew_adjusted(v: Views) -> DataFrame:
    return v.panel.groupBy("employment_type").agg(
        F.round(S.adjusted_skewness("loan_amount"), 6).alias("skew_loan"),
        F.round(S.adjusted_skewness("monthly_income"), 6).alias("skew_income"),
    )


@query(
    "mode_impute",
    """
with m as (
  select 'region' as feature, region as level, count(*) as n from {messy} x where region is not null group by all
  union all
  select 'loan_purpose', loan_purpose, count(*) from {messy} x where loan_purpose is not null group by all
), r as (select feature, level, row_number() over (partition by feature order by n desc, level) as rn from m)
select application_id,
  coalesce(region, (select level from r where rn = 1 and feature = 'region')) as region,
  coalesce(loan_purpose, (select level from r where rn = 1 and feature = 'loan_purpose')) as loan_purpose
from {messy} x""",
)
def mode_impute(v: Views) -> DataFrame:
    df = v.messy
    top = {r["feature"]: r["mode"] for r in S.modes(df, ["region", "loan_purpose"]).collect()}
    return df.select("application_id", *[F.coalesce(c, F.lit(top[c])).alias(c) for c in ("region", "loan_purpose")])


@query(
    "value_shares",
    "\nunion all\n".join(
        f"select '{c}' as feature, {c} as level, cast(count(*) as bigint) as n, round(count(*) / cast(sum(count(*)) over () as double), 9) as share from {{panel}} x where {c} is not null group by {c}"
        for c in CATS
    ),
)
def value_shares(v: Views) -> DataFrame:
    return S.value_shares(v.panel, CATS).withColumn("share", F.round("share", 9))


@query(
    "class_weights",
    """
select default_flag, cast(count(*) as bigint) as n, round(sum(count(*)) over () / (count(*) over () * cast(count(*) as double)), 9) as weight
from {application} a group by default_flag""",
)
def class_weights(v: Views) -> DataFrame:
    return S.class_weights(v.application, "default_flag").withColumn("weight", F.round("weight", 9))


@query(
    "describe",
    "\nunion all\n".join(
        f"select '{c}' as \"column\", cast(count({c}) as bigint) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 4) as std, "
        f"cast(min({c}) as double) as min, cast(max({c}) as double) as max, round(quantile_cont({c}, 0.25), 6) as p25, "
        f"round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75, "
        "cast(null as bigint) as \"unique\", cast(null as varchar) as top, cast(null as bigint) as freq from {panel} x"
        for c in NUM
    )
    + "\nunion all\n"
    + "\nunion all\n".join(
        f"select '{c}', cast(sum(n) as bigint), null, null, null, null, null, null, null, cast(count(*) as bigint), arg_max(level, (n, -rk)), cast(max(n) as bigint) "
        f"from (select {c} as level, count(*) as n, row_number() over (order by {c}) as rk from {{panel}} x where {c} is not null group by {c})"
        for c in CATS
    ),
)
def describe(v: Views) -> DataFrame:
    d = S.describe(v.panel, NUM, CATS)
    return d.select(
        "column",
        "count",
        F.round("mean", 6).alias("mean"),
        F.round("std", 4).alias("std"),
        "min",
        "max",
        *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")],
        "unique",
        "top",
        "freq",
    )


HIST = "\nunion all\n".join(
    f"""select feature, bin, cast(count(x) as bigint) as n from (select '{c}' as feature, unnest(range(0, 10)) as bin) g left join (
  select least(cast(floor(({c} - lo) / (hi - lo) * 10) as bigint), 9) as x from {{panel}} p, (select min({c}) as lo, max({c}) as hi from {{panel}} q) where {c} is not null) h on g.bin = h.x
group by feature, bin"""
    for c in ("loan_amount", "monthly_income")
)


@query("histogram", f"select feature, cast(bin as int) as bin, n from ({HIST})")
def histogram(v: Views) -> DataFrame:
    return S.histogram(v.panel, ["loan_amount", "monthly_income"], 10)


@query(
    "monthly_counts",
    "select date_trunc('month', application_date) as month, cast(count(*) as bigint) as n from {application} a group by 1",
)
def monthly_counts(v: Views) -> DataFrame:
    return S.monthly_counts(v.application, "application_date").select(F.col("month").cast("timestamp_ntz").alias("month"), "n")


@query(
    "target_trend",
    """
with d as (select cast(application_date as date) as day, avg(cast(default_flag as double)) as rate from {application} a group by 1)
select cast(day as timestamp) as day, round(rate, 9) as rate, round(avg(rate) over (order by day rows between 6 preceding and current row), 9) as rolling_rate from d""",
)
def target_trend(v: Views) -> DataFrame:
    t = S.target_trend(v.application, "application_date", "default_flag")
    return t.select(
        F.col("day").cast("timestamp_ntz").alias("day"), F.round("rate", 9).alias("rate"), F.round("rolling_rate", 9).alias("rolling_rate")
    )


EDA_NUM = ["application_id", "loan_amount", "default_flag", "monthly_income", "age"]


def _eda_sql() -> str:
    stats = [
        *[
            f"select '{c}.{n}' as item, cast({x} as double) as value, cast(null as varchar) as text from {{panel}} x"
            for c in EDA_NUM
            for n, x in {
                "count": f"count({c})", "mean": f"round(avg({c}), 6)", "std": f"round(stddev_samp({c}), 4)", "min": f"min({c})", "max": f"max({c})",
                "p25": f"round(quantile_cont({c}, 0.25), 6)", "p50": f"round(quantile_cont({c}, 0.5), 6)", "p75": f"round(quantile_cont({c}, 0.75), 6)",
            }.items()
        ],
        *[
            f"select '{c}.{n}', {value}, {text} from (select {c} as level, count(*) as n, row_number() over (order by {c}) as rk from {{panel}} x where {c} is not null group by {c})"
            for c in CATS
            for n, value, text in (
                ("count", "cast(sum(n) as double)", "null"), ("unique", "cast(count(*) as double)", "null"),
                ("freq", "cast(max(n) as double)", "null"), ("top", "null", "arg_max(level, (n, -rk))"),
            )
        ],
    ]
    counts = "\nunion all\n".join(
        f"""select feature, bin, cast(count(x) as double) as n from (select '{c}' as feature, unnest(range(0, 30)) as bin) g left join (
  select least(cast(floor((v - lo) / (hi - lo) * 30) as bigint), 29) as x from (select cast({c} as double) as v from {{panel}} p where {c} is not null),
    (select cast(min({c}) as double) as lo, cast(max({c}) as double) as hi from {{panel}} q)) h on g.bin = h.x
group by feature, bin"""
        for c in EDA_NUM[:4]
    )
    return (
        "with st as (" + "\nunion all\n".join(stats) + f"), hs as ({counts}), "
        "dy as (select cast(application_date as date) as day, avg(cast(default_flag as double)) as rate from {panel} x group by 1) "
        "select 'describe' as section, item, cast(null as double) as x, value, text from st where value is not null or text is not null "
        "union all select 'target_candidate', 'default_flag', null, null, null "
        "union all select 'date_candidate', 'application_date', null, null, null "
        "union all select 'histogram', feature, cast(bin as double), n, null from hs "
        "union all select 'trend', cast(day as varchar), round(rate, 9), round(avg(rate) over (order by day rows between 6 preceding and current row), 9), null from dy"
    )


@query("eda_job", _eda_sql())
def eda_job(v: Views) -> DataFrame:
    df = v.panel.select(*EDA_NUM, *CATS, "application_date")
    out = J.eda_job(df)
    digits = F.when(F.col("section") == "trend", 9).when(F.col("item").endswith(".std"), 4).otherwise(6)
    rounded = F.when(digits == 9, F.round("value", 9)).when(digits == 4, F.round("value", 4)).otherwise(F.round("value", 6))
    return out.select("section", "item", F.round("x", 9).alias("x"), rounded.alias("value"), "text")


@query(
    "drop_all_null",
    "select application_id, loan_amount, monthly_income from {panel} x",
)
def drop_all_null(v: Views) -> DataFrame:
    df = v.panel.select(
        "application_id", "loan_amount", F.when(F.col("loan_amount") < 0, 1.0).alias("never"), "monthly_income"
    )
    return S.drop_all_null(df)


# -- numeric ---------------------------------------------------------------------------------------------

FIT_SQL = """
with st as (
""" + "\nunion all\n".join(
    f"""  select '{c}' as feature, median({c}) as med, quantile_cont({c}, 0.01) as lo, quantile_cont({c}, 0.99) as hi, skewness({c}) as sk,
    min({c}) as mn, avg({c}) as mu, stddev_pop({c}) as sd from {{messy}} x"""
    for c in NUM
) + """
), s as (select *, abs(sk) >= 0.05 as lg, case when abs(sk) >= 0.05 and mn <= 0 then abs(mn) + 1 else cast(0 as double) end as shift from st)
"""


@query(
    "prep_numeric_fit",
    FIT_SQL
    + "select feature, round(med, 6) as median, round(lo, 6) as lower, round(hi, 6) as upper, round(sk, 6) as skew, cast(lg as int) as log, round(shift, 6) as shift, round(mu, 6) as mean, round(sd, 4) as std from s",
)
def prep_numeric_fit(v: Views) -> DataFrame:
    df = v.messy
    state = P.fit_numeric(df, NUM, log_skew=0.05)
    rows = [(c, s.median, s.lower, s.upper, s.skew, int(s.log), float(s.shift), s.mean, s.std) for c, s in state.items()]
    out = df.sparkSession.createDataFrame(
        rows, "feature string, median double, lower double, upper double, skew double, log int, shift double, mean double, std double"
    )
    digits = {"median": 6, "lower": 6, "upper": 6, "skew": 6, "shift": 6, "mean": 6, "std": 4}
    return out.select("feature", "log", *[F.round(c, d).alias(c) for c, d in digits.items()])


def _num_sql(c: str, scale: bool, source: str = "s") -> str:
    pick = f"(select {{}} from {source} where feature = '{c}')"
    med, lo, hi, lg, sh, mu, sd = (pick.format(n) for n in ("med", "lo", "hi", "lg", "shift", "mu", "sd"))
    y = f"least(greatest(coalesce({c}, {med}), {lo}), {hi})"
    y = f"case when {lg} then ln(1 + {y} + {sh}) else {y} end"
    if scale:
        y = f"(({y}) - {mu}) / ({sd} + cast(0.000001 as double))"
    return f"cast({c} is null as int) as {c}_was_missing, round({y}, 6) as {c}"


@query("prep_numeric", FIT_SQL + "select application_id, " + ", ".join(_num_sql(c, True) for c in NUM) + " from {messy} x")
def prep_numeric(v: Views) -> DataFrame:
    df = v.messy
    state = P.fit_numeric(df, NUM, log_skew=0.05)
    out = df.select("application_id", *P.numeric_expressions(df, state, scale=True))
    return out.select("application_id", *[F.round(c, 6).alias(c) if c in NUM else c for c in out.columns[1:]])


@query(
    "capper",
    """
with q as (select quantile_cont(loan_amount, 0.01) as l, quantile_cont(loan_amount, 0.99) as h,
  quantile_cont(monthly_income, 0.01) as l2, quantile_cont(monthly_income, 0.99) as h2
  from {panel} x where application_date <= timestamp '1998-12-31')
select application_id, round(least(greatest(loan_amount, l), h), 6) as loan_amount,
  round(case when monthly_income is not null then least(greatest(monthly_income, l2), h2) end, 6) as monthly_income from {panel} x, q""",
)
def capper(v: Views) -> DataFrame:
    df = v.panel.select("application_id", "application_date", "loan_amount", "monthly_income")
    train = df.filter("application_date <= timestamp_ntz '1998-12-31'")
    fitted = P.Capper.fit(train, ["loan_amount", "monthly_income"])
    return rows_of(fitted.transform(df), ["loan_amount", "monthly_income"], keys=("application_id",))


# -- categories ------------------------------------------------------------------------------------------

RARE = 0.003


def _level(c: str) -> str:
    return f"case when {c} is null then '__missing__' when trim({c}) = '' then '__empty__' else lower(trim({c})) end"


LEVEL_SQL = """
with lv as (
""" + "\nunion all\n".join(
    f"  select application_id, default_flag as y, '{c}' as feature, {_level(c)} as raw from {{messy}} x" for c in ("region", "loan_purpose")
) + f"""
), sh as (select feature, raw, count(*) / cast(sum(count(*)) over (partition by feature) as double) as share from lv group by feature, raw),
cl as (select lv.*, case when share >= {RARE} or lv.raw in ('__missing__', '__empty__') then lv.raw else '__other__' end as level
  from lv join sh on lv.feature = sh.feature and lv.raw = sh.raw),
ag as (select feature, level, count(*) as n, sum(y) as bad, count(*) / cast(sum(count(*)) over (partition by feature) as double) as freq,
  (sum(y) + 20 * (select avg(cast(default_flag as double)) from {{messy}} m)) / cast(count(*) + 20 as double) as enc from cl group by feature, level)
"""


def _states(v: Views) -> tuple[DataFrame, dict[str, P.CategoryState]]:
    df = v.messy
    return df, P.fit_categories(df, ["region", "loan_purpose"], "default_flag", rare=RARE, smoothing=20.0)


@query(
    "prep_rare",
    LEVEL_SQL + "select feature, level, cast(n as bigint) as n, cast(bad as bigint) as bad, round(freq, 9) as share from ag",
)
def prep_rare(v: Views) -> DataFrame:
    c = P.level_counts(v.messy, ["region", "loan_purpose"], "default_flag", RARE)
    return c.select(
        "feature", "level", "n", F.col("bad").cast("bigint").alias("bad"), F.round(F.col("n") / F.col("total"), 9).alias("share")
    )


def _encoded_sql(value: str, name: str) -> str:
    return LEVEL_SQL + f"""
select application_id, max(case when c.feature = 'region' then cast(c.level = '__missing__' as int) end) as region_was_missing,
  round(max(case when c.feature = 'region' then {value} end), 9) as region_{name},
  max(case when c.feature = 'loan_purpose' then cast(c.level = '__missing__' as int) end) as loan_purpose_was_missing,
  round(max(case when c.feature = 'loan_purpose' then {value} end), 9) as loan_purpose_{name}
from cl c join ag on c.feature = ag.feature and c.level = ag.level group by application_id"""


@query("enc_frequency", _encoded_sql("freq", "freq"))
def enc_frequency(v: Views) -> DataFrame:
    df, state = _states(v)
    out = df.select("application_id", *P.category_expressions(df, state, "frequency", 0.0))
    return out.select("application_id", "region_was_missing", "loan_purpose_was_missing", *[F.round(c, 9).alias(c) for c in ("region_freq", "loan_purpose_freq")])


@query("enc_target", _encoded_sql("enc", "target"))
def enc_target(v: Views) -> DataFrame:
    df, state = _states(v)
    out = df.select("application_id", *P.category_expressions(df, state, "target", 0.0))
    return out.select("application_id", "region_was_missing", "loan_purpose_was_missing", *[F.round(c, 9).alias(c) for c in ("region_target", "loan_purpose_target")])


ONEHOT = ["__empty__", "__missing__", "__other__", "africa", "america", "asia", "europe", "middle east"]


@query(
    "enc_onehot",
    LEVEL_SQL
    + "select application_id, cast(level = '__missing__' as int) as region_was_missing, "
    + ", ".join(f"cast(level = '{x}' as int) as \"region_{x}\"" for x in ONEHOT)
    + " from cl where feature = 'region'",
)
def enc_onehot(v: Views) -> DataFrame:
    df = v.messy
    state = P.fit_categories(df, ["region"], "default_flag", rare=RARE)
    return df.select("application_id", *P.category_expressions(df, state, "onehot", 0.0))


@query(
    "enc_target_sigmoid",
    """
with g as (select avg(cast(toxic as double)) as mu from {doc_risk} r),
s as (select source, avg(cast(toxic as double)) as m, count(*) as n from {doc_risk} r group by source),
e as (select source, mu * (1 - 1 / (1 + exp(-(n - 20) / cast(5 as double)))) + m * (1 / (1 + exp(-(n - 20) / cast(5 as double)))) as enc from s, g)
select doc_id, round(coalesce(enc, mu), 9) as source_encoded from g, {doc_risk} r left join e on r.source = e.source""",
)
def enc_target_sigmoid(v: Views) -> DataFrame:
    df = v.doc_risk.select("doc_id", "source", "toxic")
    out = P.encode_sigmoid_target(df, ["source"], "toxic", smoothing=5.0, min_leaf=20)
    return out.select("doc_id", F.round("source_encoded", 9).alias("source_encoded"))


@query(
    "enc_target_folds",
    """
with g as (select avg(cast(toxic as double)) as mu from {doc_risk} r),
f as (select doc_id, source, toxic, n_chars % 5 as fold from {doc_risk} r),
e as (select a.source, a.fold, sum(b.toxic) as s, count(b.toxic) as n from (select distinct source, fold from f) a left join f b on a.source = b.source and a.fold <> b.fold group by 1, 2),
x as (select source, fold, mu * (1 - 1 / (1 + exp(-(n - 20) / cast(5 as double)))) + s / nullif(cast(n as double), 0) * (1 / (1 + exp(-(n - 20) / cast(5 as double)))) as enc from e, g)
select f.doc_id, f.source, f.toxic, round(coalesce(enc, mu), 9) as source_encoded from g, f left join x on f.source = x.source and f.fold = x.fold""",
)
def enc_target_folds(v: Views) -> DataFrame:
    df = v.doc_risk.select("doc_id", "source", "toxic", "n_chars")
    out = P.encode_target_out_of_fold(df, "source", "toxic", F.col("n_chars") % 5, smoothing=5.0, min_leaf=20)
    return out.select("doc_id", "source", "toxic", F.round("source_encoded", 9).alias("source_encoded"))


# -- binning ---------------------------------------------------------------------------------------------

WOE_COLS = ["loan_amount", "monthly_income", "age"]


def _edges_sql(bins: int, columns=WOE_COLS, source: str = "{messy}", y: str = "default_flag", key: str = "application_id") -> str:
    probs = "[" + ", ".join(f"{i / bins}" for i in range(bins + 1)) + "]"
    long = "\nunion all\n".join(f"  select {key}, {y} as y, '{c}' as feature, cast({c} as double) as x from {source} m" for c in columns)
    return f"""
with lg as (
{long}
), ed as (select feature, list_sort(list_distinct(quantile_cont(x, {probs}))) as edges from lg where x is not null group by feature),
bn as (select lg.*, edges, case when x is null or x < edges[1] or x > edges[len(edges)] then null when x = edges[1] then 1
  else len(list_filter(edges, lambda e: e < x)) end as bin from lg join ed using (feature) where len(edges) >= 2)
"""


WOE_SQL = _edges_sql(5) + """, sb as (
  select feature, bin, count(*) as n, sum(y) as bad, count(*) - sum(y) as good, any_value(edges) as edges from bn
  where bin is not null group by feature, bin having count(*) >= 50 and sum(y) > 0),
w0 as (select *, bad / cast(sum(bad) over (partition by feature) as double) as br, good / cast(sum(good) over (partition by feature) as double) as gr from sb),
w1 as (select *, ln((br + cast(0.000001 as double)) / (gr + cast(0.000001 as double))) as raw from w0),
w as (select *, max(raw) over (partition by feature order by bin rows between unbounded preceding and current row) as woe from w1)
"""


@query(
    "bin_edges",
    _edges_sql(5) + "select feature, cast(i as int) as edge_no, round(edges[i], 6) as edge from ed, unnest(range(1, len(edges) + 1)) t(i)",
)
def bin_edges(v: Views) -> DataFrame:
    df = v.messy
    edges = W.bin_edges(df, WOE_COLS, 5)
    rows = [(c, i, e) for c, es in edges.items() for i, e in enumerate(es, start=1)]
    out = df.sparkSession.createDataFrame(rows, "feature string, edge_no int, edge double")
    return out.withColumn("edge", F.round("edge", 6))


@query(
    "bin_assign",
    _edges_sql(5)
    + "select application_id, "
    + ", ".join(f"cast(max(case when feature = '{c}' then bin end) as int) as {c}_bin" for c in WOE_COLS)
    + " from bn group by application_id",
)
def bin_assign(v: Views) -> DataFrame:
    df = v.messy
    out = W.assign_bins(df, W.bin_edges(df, WOE_COLS, 5))
    return out.select("application_id", *[f"{c}_bin" for c in WOE_COLS])


@query(
    "woe_table",
    WOE_SQL
    + """select feature, cast(bin as int) as bin, round(edges[bin], 6) as lo, round(edges[bin + 1], 6) as hi, cast(n as bigint) as n,
  cast(bad as bigint) as bad, cast(good as bigint) as good, round(raw, 9) as woe_raw, round(woe, 9) as woe from w""",
)
def woe_table(v: Views) -> DataFrame:
    df = v.messy
    t = W.woe_table(df, W.bin_edges(df, WOE_COLS, 5), "default_flag")
    return t.select(
        "feature", "bin", "n", "bad", "good", *[F.round(c, d).alias(c) for c, d in (("lo", 6), ("hi", 6), ("woe_raw", 9), ("woe", 9))]
    )


@query("iv_ranking", WOE_SQL + "select feature, round(sum((br - gr) * woe), 9) as iv from w group by feature")
def iv_ranking(v: Views) -> DataFrame:
    df = v.messy
    t = W.woe_table(df, W.bin_edges(df, WOE_COLS, 5), "default_flag")
    return W.iv_ranking(t).withColumn("iv", F.round("iv", 9))


@query(
    "woe_encode",
    WOE_SQL
    + "select application_id, "
    + ", ".join(f"round(coalesce(max(case when bn.feature = '{c}' then woe end), 0), 9) as {c}_woe" for c in WOE_COLS)
    + " from bn left join w on bn.feature = w.feature and bn.bin = w.bin group by application_id",
)
def woe_encode(v: Views) -> DataFrame:
    df = v.messy
    out = W.WoeModel.fit(df, WOE_COLS, "default_flag", bins=5, min_samples=50).transform(df)
    return out.select("application_id", *[F.round(f"{c}_woe", 9).alias(f"{c}_woe") for c in WOE_COLS])


CORR = [("revolving_balance", "min_payment"), ("revolving_balance", "payment_amount"), ("revolving_balance", "due_amount"), ("revolving_balance", "dpd"),
        ("min_payment", "payment_amount"), ("min_payment", "due_amount"), ("min_payment", "dpd"), ("payment_amount", "due_amount"),
        ("payment_amount", "dpd"), ("due_amount", "dpd")]


@query(
    "correlation_filter",
    "with c as ("
    + "\nunion all\n".join(f"select '{b}' as \"column\", corr({a}, {b}) as r from {{history}} h" for a, b in CORR)
    + ") select \"column\", round(max(abs(r)), 6) as max_abs_corr from c where abs(r) > 0.9 group by 1",
)
def correlation_filter(v: Views) -> DataFrame:
    cols = ["revolving_balance", "min_payment", "payment_amount", "due_amount", "dpd"]
    return W.correlation_filter(v.history, cols, 0.9).withColumn("max_abs_corr", F.round("max_abs_corr", 6))


MI_SQL = _edges_sql(10) + """, c as (select feature, coalesce(bin, 0) as b, y, count(*) as n from bn group by 1, 2, 3),
j as (select *, cast(sum(n) over (partition by feature) as double) as t, sum(n) over (partition by feature, b) as nx, sum(n) over (partition by feature, y) as ny from c)
select feature, round(sum(n / t * ln(n * t / cast(nx as double) / ny)), 9) as mutual_info from j group by feature"""


@query("mutual_information", MI_SQL)
def mutual_information(v: Views) -> DataFrame:
    m = W.mutual_information(v.messy, WOE_COLS, "default_flag", bins=10)
    return m.withColumn("mutual_info", F.round("mutual_info", 9))


KNN_COLS = ["loan_amount", "monthly_income", "age"]


@query(
    "mutual_information_knn",
    "with x as ("
    + "\nunion all\n".join(f"select '{c}' as feature, default_flag as y, coalesce(cast({c} as double), 0) as v from {{messy}} x" for c in KNN_COLS)
    + """), sized as (select *, count(*) over (partition by feature, y) as ny, count(*) over (partition by feature) as t from x),
near as (select *, least(3, ny - 1) as k, list_sort([v - lag(v, 1) over w, v - lag(v, 2) over w, v - lag(v, 3) over w,
    lead(v, 1) over w - v, lead(v, 2) over w - v, lead(v, 3) over w - v], 'ASC', 'NULLS LAST') as d
  from sized window w as (partition by feature, y order by v)),
far as (select *, d[k] as r from near),
upto as (select feature, v as u, sum(count(*)) over (partition by feature order by v) as le from x group by feature, v),
high as (select f.*, a.le as hi from far f asof left join upto a on f.feature = a.feature and f.v + f.r > a.u where f.r > 0
  union all select f.*, a.le from far f join upto a on f.feature = a.feature and f.v = a.u where f.r = 0),
low as (select f.*, coalesce(a.le, 0) as lo from high f asof left join upto a on f.feature = a.feature and f.v - f.r >= a.u where f.r > 0
  union all select f.*, coalesce(a.le, 0) from high f asof left join upto a on f.feature = a.feature and f.v > a.u where f.r = 0),
harmonic as (select i + 1 as n, sum(cast(1 as double) / nullif(i, 0)) over (order by i) as h from range(0, (select max(t) + 1 from sized)) g(i)),
psi as (select n, coalesce(h, 0) as h from harmonic)
select feature, round(greatest(0, max(pt.h) + avg(pk.h) - avg(py.h) - avg(pm.h)), 9) as mutual_info
from low l join psi pt on pt.n = l.t join psi pk on pk.n = l.k join psi py on py.n = l.ny join psi pm on pm.n = cast(l.hi - l.lo as bigint)
group by feature""",
)
def mutual_information_knn(v: Views) -> DataFrame:
    m = N.neighbour_information(v.messy, KNN_COLS, "default_flag")
    return m.withColumn("mutual_info", F.round("mutual_info", 9))


# -- whole pipelines -------------------------------------------------------------------------------------


@query(
    "prep_full",
    LEVEL_SQL.replace("with lv", FIT_SQL.strip().rstrip() + ", lv", 1)
    + """, pr as (select application_id, customer_ref, default_flag, """
    + ", ".join(f"case when (select lg from s where feature = '{c}') then ln(1 + z_{c} + (select shift from s where feature = '{c}')) else z_{c} end as {c}, m_{c}" for c in NUM)
    + " from (select *, "
    + ", ".join(
        f"least(greatest(coalesce({c}, (select med from s where feature = '{c}')), (select lo from s where feature = '{c}')), (select hi from s where feature = '{c}')) as z_{c}, cast({c} is null as int) as m_{c}"
        for c in NUM
    )
    + " from {messy} x))"
    + ", "
    + WOE_SQL.replace("{messy}", "pr").strip()[5:].replace("count(*) >= 50", "count(*) >= 100")
    + """, wo as (select bn.application_id, """
    + ", ".join(f"coalesce(max(case when bn.feature = '{c}' then woe end), 0) as {c}_woe" for c in WOE_COLS)
    + """ from bn left join w on bn.feature = w.feature and bn.bin = w.bin group by bn.application_id),
en as (select application_id,
  max(case when c.feature = 'region' then cast(c.level = '__missing__' as int) end) as region_was_missing,
  max(case when c.feature = 'region' then enc end) as region_target,
  max(case when c.feature = 'loan_purpose' then cast(c.level = '__missing__' as int) end) as loan_purpose_was_missing,
  max(case when c.feature = 'loan_purpose' then enc end) as loan_purpose_target
  from cl c join ag on c.feature = ag.feature and c.level = ag.level group by application_id)
select pr.application_id, pr.customer_ref, """
    + ", ".join(f"m_{c} as {c}_was_missing, round(pr.{c}, 6) as {c}, round(wo.{c}_woe, 6) as {c}_woe" for c in NUM)
    + """, region_was_missing, round(region_target, 6) as region_target, loan_purpose_was_missing, round(loan_purpose_target, 6) as loan_purpose_target
from pr join wo using (application_id) join en using (application_id)""",
)
def prep_full(v: Views) -> DataFrame:
    df = materialize(v.messy, "messy")
    cfg = P.PrepConfig(
        target="default_flag",
        drop=("application_id", "application_date"),
        numeric=NUM,
        categorical=["region", "loan_purpose"],
        log_skew=0.05,
        rare=RARE,
        encoding="target",
        woe=True,
        min_samples=100,
    )
    out = P.fit_prep(df, cfg).transform(df, keep=["application_id"])
    real = [c for c in out.columns if not c.endswith(("_was_missing", "_id", "_ref"))]
    return out.select(*[F.round(c, 6).alias(c) if c in real else c for c in out.columns])


@query(
    "prep_classic",
    """
with f as (select application_id, application_date, region, loan_amount || ' uzs' as money_text,
    coalesce(monthly_income, (select median(monthly_income) from {messy} m)) as inc, coalesce(loan_amount, (select median(loan_amount) from {messy} m)) as loan from {messy} x),
b as (select quantile_cont(inc, 0.01) as il, quantile_cont(inc, 0.99) as ih, quantile_cont(loan, 0.01) as ll, quantile_cont(loan, 0.99) as lh from f),
c as (select f.*, least(greatest(inc, il), ih) as inc_c, least(greatest(loan, ll), lh) as loan_c from f, b),
m as (select avg(inc_c) as im, stddev_pop(inc_c) as isd, avg(loan_c) as lm, stddev_pop(loan_c) as lsd, avg(loan) as mm, stddev_pop(loan) as msd from c),
md as (select region from f where region is not null group by region order by count(*) desc, region limit 1)
select application_id, round((inc_c - im) / isd, 6) as monthly_income, round((loan_c - lm) / lsd, 6) as loan_amount,
  cast(coalesce(region, (select region from md)) = 'asia' as int) as region_asia,
  cast(coalesce(region, (select region from md)) = ' ASIA ' as int) as "region_ ASIA ",
  cast(coalesce(region, (select region from md)) = '  ' as int) as "region_  ",
  cast(epoch(application_date) as bigint) as application_date_epoch,
  round((loan - mm) / msd, 6) as money_text_money
from c, m""",
)
def prep_classic(v: Views) -> DataFrame:
    df = materialize(v.messy, "messy").select(
        "application_id",
        "application_date",
        "region",
        "monthly_income",
        "loan_amount",
        F.concat(F.format_string("%.2f", "loan_amount"), F.lit(" uzs")).alias("money_text"),
    )
    roles = P.ColumnRoles(["monthly_income", "loan_amount"], ["region"], ["application_date"], ["money_text"])
    out = P.fit_classic(df, roles).transform(df, keep=["application_id"])
    return out.select(
        "application_id",
        *[F.round(c, 6).alias(c) for c in ("monthly_income", "loan_amount", "money_text_money")],
        "region_asia",
        "region_ ASIA ",
        "region_  ",
        "application_date_epoch",
    )
