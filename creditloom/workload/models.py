"""Model, calibration, blend and explanation queries."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import calibrate as K
from creditloom.operators import explain as E
from creditloom.operators import jobs as J
from creditloom.operators import models as L
from creditloom.operators.diagnostics import top_features
from creditloom.operators.woe import WoeModel
from creditloom.plans.session import scratch_path
from creditloom.workload.base import VIEW_SQL, Views, query
from creditloom.workload import ranking  # noqa: F401  (defines the split view)
from creditloom.workload.prep import WOE_SQL

VIEW_SQL["trainset"] = """
select application_id, customer_ref, split, default_flag as target, loan_amount, coalesce(monthly_income, 0) as monthly_income,
       cast(age as double) as age, loan_amount / (coalesce(monthly_income, 0) + 1000) as loan_ratio,
       cast(extract(month from application_date) as double) as season
from {splits} s"""

INPUTS = ["loan_amount", "monthly_income", "age", "loan_ratio", "season"]
SMALL = {"maxIter": 5, "maxDepth": 3}


def parts(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = v.trainset
    return tuple(df.filter(F.col("split") == s) for s in ("train", "valid", "oot"))


def fit_small(df: DataFrame) -> L.TreeModel:
    return L.train_trees(df, "target", INPUTS, "boosted", **SMALL)


@query("champion_scores")
def champion_scores(v: Views) -> DataFrame:
    train, valid, _ = parts(v)
    model = L.train_champion(train, "target", INPUTS)
    return model.score(valid, "p").select("application_id", "target", "p")


@query("challenger_scores")
def challenger_scores(v: Views) -> DataFrame:
    train, valid, _ = parts(v)
    scored = fit_small(train).score(valid, "p_boosted")
    forest = L.train_trees(train, "target", INPUTS, "forest", numTrees=10, maxDepth=4)
    return forest.score(scored, "p_forest").select("application_id", "target", "p_boosted", "p_forest")


@query("challenger_importance")
def challenger_importance(v: Views) -> DataFrame:
    train, _, _ = parts(v)
    imp = L.mean_importance([fit_small(train)])
    return v.spark.createDataFrame(imp, "feature string, importance double")


@query("importance_topk")
def importance_topk(v: Views) -> DataFrame:
    train, valid, _ = parts(v)
    boosted = fit_small(train)
    forest = L.train_trees(train, "target", INPUTS, "forest", numTrees=10, maxDepth=4)
    lost = L.permutation_importance(boosted, valid, "target", "application_id", INPUTS)
    rows = [(c, i, lost[c]) for c, i in L.mean_importance([boosted, forest])]
    table = v.spark.createDataFrame(rows, "feature string, importance double, auc_lost double")
    return top_features(table, "importance", 3)


@query("stability_selection")
def stability_selection(v: Views) -> DataFrame:
    train, _, _ = parts(v)

    def forest(df: DataFrame) -> L.TreeModel:
        return L.train_trees(df, "target", INPUTS, "forest", numTrees=5, maxDepth=4)

    return v.spark.createDataFrame(L.stability_selection(forest, train, "application_id", rounds=3), "feature string, stability double")


@query("random_search")
def random_search(v: Views) -> DataFrame:
    train, valid, _ = parts(v)
    found = L.random_search(
        train, valid, "target", INPUTS, {"stepSize": (0.05, 0.3), "maxDepth": (2, 4)}, n=3, maxIter=3
    )
    rows = [(i, float(p["stepSize"]), int(p["maxDepth"]), float(a)) for i, (p, a) in enumerate(found)]
    return v.spark.createDataFrame(rows, "trial int, step_size double, max_depth int, roc_auc double")


@query("leak_sanity")
def leak_sanity(v: Views) -> DataFrame:
    train, valid, _ = parts(v)
    model = fit_small(train)
    model.metrics = L.measure(model, valid, "target")
    shuffled = L.shuffled_auc(fit_small, train, valid, "target", "application_id")
    return v.spark.createDataFrame(
        [(model.metrics["roc_auc"], shuffled, int(L.is_suspicious(model.metrics)), int(shuffled >= 0.62))],
        "roc_auc double, shuffled_auc double, too_good int, leaks int",
    )


BLENDS = [[1 / 3, 1 / 3, 1 / 3], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.2, 0.5, 0.3]]
VIEW_SQL["three_scores"] = """
select application_id, y, p as p1, cast((application_id * 104729) % 997 as double) / cast(997 as double) as p2,
       case when y = 1 then p * cast(0.5 as double) + cast(0.5 as double) else p * cast(0.9 as double) end as p3
from {scored} s"""


def _blend_sql() -> str:
    rows = "\nunion all\n".join(
        f"select {i} as candidate, y, p1 * {w[0]!r}e0 + p2 * {w[1]!r}e0 + p3 * {w[2]!r}e0 as p from {{three_scores}} s" for i, w in enumerate(BLENDS)
    )
    return f"""
with lg as ({rows}),
g as (select candidate, p, count(*) as n, cast(sum(y) as bigint) as pos from lg group by 1, 2),
c as (select *, n - pos as neg, sum(n - pos) over (partition by candidate order by p rows between unbounded preceding and current row) as cneg,
  sum(pos) over (partition by candidate) as pt, sum(n - pos) over (partition by candidate) as nt from g)
select cast(candidate as int) as candidate, round(sum(pos * (cneg - neg + neg / cast(2 as double))) / (max(pt) * cast(max(nt) as double)), 6) as value from c group by candidate"""


@query("blend_weights", _blend_sql())
def blend_weights(v: Views) -> DataFrame:
    out = L.blend_scores(v.three_scores, ["p1", "p2", "p3"], BLENDS, "y")
    return out.withColumn("value", F.round("value", 6))


@query("ensemble_scores")
def ensemble_scores(v: Views) -> DataFrame:
    train, valid, oot = parts(v)
    members = [L.train_champion(train, "target", INPUTS), fit_small(train)]
    model = L.train_ensemble(members, valid, "target", trials=10, min_weight=0.05)
    return model.score(oot, "p").select("application_id", "target", "p")


@query("stacking_scores")
def stacking_scores(v: Views) -> DataFrame:
    train, valid, oot = parts(v)

    def shallow(df: DataFrame) -> L.TreeModel:
        return L.train_trees(df, "target", INPUTS, "forest", numTrees=5, maxDepth=3)

    fits = [fit_small, shallow]
    model = L.train_stacking(fits, [f(train) for f in fits], train, valid, "target", "application_id", folds=2)
    return model.score(oot, "p").select("application_id", "target", "p")


@query("calibrate_platt")
def calibrate_platt(v: Views) -> DataFrame:
    df = v.three_scores
    return K.fit_platt(df, "y", "p3").apply(df, "p3", "calibrated").select("application_id", "p3", "calibrated")


# The increasing fit at a score is the largest, over lower starts, of the smallest mean over higher ends.
ISOTONIC = """
with pt as (select p3 as x, sum(y) as s, cast(count(*) as double) as n from {three_scores} t group by p3),
cm as (select x, row_number() over (order by x) as i, sum(s) over (order by x) as cs, sum(n) over (order by x) as cn, s, n from pt),
ab as (select a.i as a, b.i as b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) as m from cm a join cm b on b.i >= a.i),
lo as (select a, b as i, min(m) over (partition by a order by b desc) as low from ab),
fit as (select i, max(low) as value from lo group by i)
select application_id, p3, round(value, 9) as calibrated from {three_scores} t join cm on t.p3 = cm.x join fit on fit.i = cm.i"""


@query("calibrate_isotonic", ISOTONIC)
def calibrate_isotonic(v: Views) -> DataFrame:
    df = v.three_scores
    out = K.fit_isotonic(df, "y", "p3").apply(df, "p3", "calibrated")
    return out.select("application_id", "p3", F.round("calibrated", 9).alias("calibrated"))


@query("calibrate_best")
def calibrate_best(v: Views) -> DataFrame:
    _, found = K.fit_best(v.three_scores, "y", "p3")
    best = "platt" if found["platt_brier"] <= found["isotonic_brier"] else "isotonic"
    return v.spark.createDataFrame([(best, found["platt_brier"], found["isotonic_brier"])], "method string, platt_brier double, isotonic_brier double")


GIVEN = {"loan_amount": 0.8, "monthly_income": -1.1, "age": 0.4}


def _reasons_sql() -> str:
    parts_sql = "\nunion all\n".join(
        f"select bn.application_id, bn.feature, coalesce(w.woe, 0) * {b!r}e0 as c from bn left join w on bn.feature = w.feature and bn.bin = w.bin where bn.feature = '{f}'"
        for f, b in GIVEN.items()
    )
    return (
        WOE_SQL
        + f""", ct as ({parts_sql}), rk as (select *, row_number() over (partition by application_id order by round(abs(c), 12) desc, feature) as rn from ct)
select application_id, cast(rn as int) as position, feature, round(c, 9) + 0 as contribution from rk where rn <= 2"""
    )


GIVEN_INTERCEPT = -1.25


def _explanation_sql() -> str:
    fitted = [f"select 'intercept' as section, cast(null as bigint) as application_id, cast(null as int) as position, cast(null as varchar) as feature, {GIVEN_INTERCEPT!r}e0 as value"]
    fitted += [f"select 'coefficient', null, {i}, '{f}', {b!r}e0" for i, (f, b) in enumerate(GIVEN.items(), 1)]
    head, _, last = _reasons_sql().rpartition("\nselect ")
    return head + "\n" + " union all ".join(fitted) + " union all select 'reason', " + last.replace("contribution from", "value from")


@query("explain_export", _explanation_sql())
def explain_export(v: Views) -> DataFrame:
    """Written as JSON lines and read back."""
    woe = WoeModel.fit(v.messy, list(GIVEN), "default_flag", bins=5, min_samples=50)
    model = L.Champion("logistic_woe", list(GIVEN), woe=woe, coefficients=list(GIVEN.values()), intercept=GIVEN_INTERCEPT)
    path = J.export_explanation(model, v.messy, ["application_id"], scratch_path(v.spark, "explanation"), 2)
    out = v.spark.read.schema("section string, application_id bigint, position int, feature string, value double").json(path)
    return out.withColumn("value", F.when(F.col("section") == "reason", F.round("value", 9) + 0).otherwise(F.col("value")))


@query("reason_codes", _reasons_sql())
def reason_codes(v: Views) -> DataFrame:
    df = v.messy
    woe = WoeModel.fit(df, list(GIVEN), "default_flag", bins=5, min_samples=50)
    cells = {f: F.round(woe.encode(F.col(f).cast("double"), f) * F.lit(b), 12) for f, b in GIVEN.items()}
    out = df.select("application_id", E.reason_codes(cells, top_k=2).alias("factors"))
    flat = out.select("application_id", F.posexplode("factors").alias("i", "f"))
    return flat.select(
        "application_id", (F.col("i") + 1).alias("position"), F.col("f.feature").alias("feature"), (F.round("f.contribution", 9) + 0).alias("contribution")
    )


@query("scorecard_table")
def scorecard_table(v: Views) -> DataFrame:
    train, _, _ = parts(v)
    return E.scorecard_table(L.train_champion(train, "target", INPUTS), train, "target")


@query("champion_explain")
def champion_explain(v: Views) -> DataFrame:
    train, valid, _ = parts(v)
    return E.champion_reasons(L.train_champion(train, "target", INPUTS), valid, ["application_id"])


