"""Default-detection rule pack: combined-risk flags, a points score and stress products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.expr import as_double, clip, containing, flag
from creditloom.plans.ranked import quantile_map

# Name tokens per role, and whether the last or the first matching column is used.
LAST_MATCH = {
    "score": ("score",),
    "dti": ("debt_to_income", "dti"),
    "delinq": ("delinquenc", "dpd"),
    "util": ("util",),
    "support": ("customer_service", "support"),
    "login": ("login", "session"),
    "unemployment": ("unemployment",),
    "area_income": ("median_income",),
}
FIRST_MATCH = {
    "income": ("income",),
    "cash": ("cash_flow", "cashflow"),
    "collection": ("collection",),
}


def detection_roles(columns: list[str]) -> dict[str, str]:
    found: dict[str, str] = {}
    for role, tokens in LAST_MATCH.items():
        hits = containing(columns, *tokens)
        if hits:
            found[role] = hits[-1]
    for role, tokens in FIRST_MATCH.items():
        hits = containing(columns, *tokens)
        if hits:
            found[role] = hits[0]
    ages = [c for c in columns if c.lower() == "age"]
    if ages:
        found["age"] = ages[-1]
    jobs = [c for c in columns if "employment" in c.lower() and "length" in c.lower()]
    if jobs:
        found["job"] = jobs[0]
    return found


def _inputs(df: DataFrame) -> tuple[dict[str, str], dict[str, Column], dict[str, Column]]:
    """Columns by role, their numbers, and those that count as 0 where they are missing."""
    role = detection_roles(df.columns)
    raw = {r: as_double(df, c) for r, c in role.items()}
    return role, raw, {r: F.coalesce(raw[r], F.lit(0.0)) for r in ("delinq", "util", "support", "login", "collection") if r in raw}


def detection_cuts(df: DataFrame, known: dict[str, float | None] | None = None) -> dict[str, float | None]:
    """``income_q30``, ``support_median`` and ``login_median`` of this frame as far as its rules need them; ``known`` ones are kept."""
    role, raw, zero = _inputs(df)
    cuts = dict(known or {})
    fitted: dict[str, tuple[Column, int]] = {}
    if "income" in role and "dti" in role:
        fitted["income_q30"] = (raw["income"], 0)
    if "support" in role and "login" in role:
        fitted |= {"support_median": (zero["support"], 1), "login_median": (zero["login"], 1)}
    todo = [name for name in fitted if name not in cuts]
    if todo:
        found = quantile_map(df.select(*[fitted[n][0].alias(n) for n in todo]), todo, [0.3, 0.5])
        cuts |= {n: found[n][fitted[n][1]] if n in found else None for n in todo}
    return cuts


def needs_cuts(df: DataFrame) -> bool:
    role = detection_roles(df.columns)
    return ("income" in role and "dti" in role) or ("support" in role and "login" in role)


def detection_features(df: DataFrame, cuts: dict[str, float | None] | None = None) -> dict[str, Column]:
    """Rule columns for every rule whose inputs exist.

    ``cuts`` may carry fitted ``income_q30``, ``support_median`` and ``login_median``; otherwise they are
    taken from this frame.
    """
    role, raw, zero = _inputs(df)
    cuts = {n: None if c is None else float(c) for n, c in detection_cuts(df, cuts).items()}

    def given(*roles: str) -> bool:
        return all(r in role for r in roles)

    score, dti, income, age, job = (raw.get(r) for r in ("score", "dti", "income", "age", "job"))
    out: dict[str, Column] = {}
    if given("score", "dti", "delinq"):
        out["extreme_risk_combo"] = flag((score < 600) & (dti > 0.5) & (zero["delinq"] > 0))
        out["critical_risk_combo"] = flag((score < 650) & (dti > 0.43))
    if given("dti", "income"):
        out["high_debt_low_income"] = flag((dti > 0.6) & (income < F.lit(cuts["income_q30"]).cast("double")))
    if given("age", "util"):
        out["young_high_utilization"] = flag((age < 30) & (zero["util"] > 0.8))
    if given("job", "dti"):
        out["unstable_employment_high_debt"] = flag((job < 2) & (dti > 0.5))
    points: list[Column] = []
    if given("score"):
        points.append(flag(score < 650) * 3)
    if given("dti"):
        points.append(flag(dti > 0.5) * 3)
    if given("delinq"):
        points.append(flag(zero["delinq"] > 0) * 2)
    if given("util"):
        points.append(flag(zero["util"] > 0.7) * 2)
    if points:
        out["default_risk_score"] = sum(points[1:], points[0])
    if given("delinq", "dti"):
        out["credit_history_debt_stress"] = zero["delinq"] * dti
    if given("util", "dti"):
        out["utilization_debt_product"] = zero["util"] * dti
    if given("age", "score"):
        out["age_score_interaction"] = (40 - clip(age, 20.0, 40.0)) * (750 - clip(score, 300.0, 750.0))
    if given("cash"):
        out["negative_cash_flow"] = flag(raw["cash"] < 0)
        out["severe_cash_deficit"] = flag(raw["cash"] < -500)
    if given("dti"):
        out["extreme_dti"] = flag(dti > 0.85)
        out["dti_danger_zone"] = flag((dti > 0.6) & (dti <= 0.85))
    if given("support", "login"):
        busy = zero["support"] > F.lit(cuts["support_median"]).cast("double") * 1.5
        absent = zero["login"] < F.lit(cuts["login_median"]).cast("double") * 0.5
        out["support_intensive_low_engagement"] = flag(busy & absent)
    if given("unemployment", "income", "area_income"):
        out["regional_economic_stress"] = flag((raw["unemployment"] > 0.08) & (income < raw["area_income"]))
    if given("age", "job", "dti"):
        out["triple_risk_young_unstable_debt"] = flag((age < 30) & (job < 2) & (dti > 0.5))
    if given("delinq", "collection"):
        out["credit_history_ruined"] = flag((zero["delinq"] > 1) & (zero["collection"] > 0))
        out["delinquency_collection_severity"] = zero["delinq"] + zero["collection"] * 2
    if given("util"):
        out["maxed_out_credit"] = flag(zero["util"] > 0.95)
    return out
