"""Point-in-time history features.

Every application sees its customer's statements dated at or before the application and inside an
observation window.  Joining statements to applications row by row would emit applications x statements
for each customer, which is quadratic for a customer that owns a large share of both tables.  Instead:

* statements are folded to one mergeable state per (customer, statement date), the only pass over the
  raw history;
* applications are folded to distinct (customer, application date);
* the two folded sides meet in one equi-join on the customer with the date range in the join condition,
  so the pairs of one customer are bounded by its number of distinct dates, not by its rows;
* one grouping computes all windows at once, and the result is joined back to the applications.

The wide plan is declared once; a query that selects a few outputs lets Catalyst drop the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.expr import as_double, containing, first_match, flag, safe_ratio
from creditloom.plans.joins_util import join_dates

# Name tokens that give a history column its role.
DPD_TOKENS = ("dpd", "delinq", "overdue")
PAYMENT_TOKENS = ("payment",)
BALANCE_TOKENS = ("debt", "balance")
UTILISATION_USED_TOKENS = ("credit_usage", "revolving_balance")
UTILISATION_LIMIT_TOKENS = ("limit", "available_credit")


@dataclass(frozen=True)
class HistoryConfig:
    entity: str = "customer_ref"
    application_id: str = "application_id"
    application_date: str = "application_date"
    date: str = "statement_date"
    # Columns that order statements of one date; without any, all columns do.
    tiebreak: Sequence[str] = ()
    observation_months: int = 12
    windows: Sequence[int] = (3, 6, 12)
    dpd_thresholds: Sequence[int] = (30, 60, 90)
    numeric: Sequence[str] | None = None
    # Statement dates carry no time of day (known without asking when the column is a DATE).
    day_grain: bool = False

    def order_columns(self, history: DataFrame) -> list[str]:
        return list(self.tiebreak) or [c for c in history.columns if c not in (self.entity, self.date)]


@dataclass
class HistoryColumns:
    """Roles of the history columns, found by name."""

    dpd: list[str] = field(default_factory=list)
    payment: str | None = None
    balance: str | None = None
    used: str | None = None
    limit: str | None = None
    minimum: str | None = None

    @classmethod
    def of(cls, columns: list[str]) -> "HistoryColumns":
        def head(found: list[str]) -> str | None:
            return found[0] if found else None

        return cls(
            dpd=containing(columns, *DPD_TOKENS),
            payment=head(containing(columns, *PAYMENT_TOKENS)),
            balance=head(containing(columns, *BALANCE_TOKENS)),
            used=head(containing(columns, *UTILISATION_USED_TOKENS)),
            limit=head(containing(columns, *UTILISATION_LIMIT_TOKENS)),
            minimum=head([c for c in containing(columns, "min") if "payment" in c.lower()]),
        )


def _series(history: DataFrame, roles: HistoryColumns) -> dict[str, Column]:
    """Per-statement values the windows are built from."""
    out: dict[str, Column] = {}
    if roles.dpd:
        values = [as_double(history, c) for c in roles.dpd]
        out["dpd"] = F.greatest(*values) if len(values) > 1 else values[0]
    if roles.payment:
        out["pay"] = as_double(history, roles.payment)
    if roles.balance:
        out["bal"] = as_double(history, roles.balance)
    if roles.used and roles.limit:
        out["util"] = safe_ratio(as_double(history, roles.used), as_double(history, roles.limit))
    if roles.payment and roles.balance:
        out["p2d"] = safe_ratio(as_double(history, roles.payment), as_double(history, roles.balance))
    if roles.payment and roles.minimum:
        out["under"] = flag(as_double(history, roles.payment) < as_double(history, roles.minimum))
    return out


def statement_states(history: DataFrame, cfg: HistoryConfig, roles: HistoryColumns) -> DataFrame:
    """One mergeable state per (entity, statement date)."""
    numeric = list(cfg.numeric or [])
    flags = [f"dpd_{t}_flag" for t in cfg.dpd_thresholds if f"dpd_{t}_flag" in history.columns]
    series = _series(history, roles)
    rows = history.filter(F.col(cfg.date).isNotNull() & F.col(cfg.entity).isNotNull()).select(
        F.col(cfg.entity).alias("ent"),
        F.col(cfg.date).cast("timestamp_ntz").alias("ts"),
        F.struct(*[F.col(c) for c in cfg.order_columns(history)]).alias("rid"),
        *[c.alias(name) for name, c in series.items()],
        *[as_double(history, c).alias(f"num_{c}") for c in [*numeric, *flags]],
    )
    # Order-dependent values inside one date; later dates continue the count (see below).
    same_day = Window.partitionBy("ent", "ts").orderBy("rid")
    upto = same_day.rowsBetween(Window.unboundedPreceding, 0)
    extra: dict[str, Column] = {}
    has = series.keys()
    if "dpd" in has:
        extra["was"] = flag(F.col("dpd") > 0)
    if "util" in has:
        extra["util0"] = F.coalesce("util", F.lit(0.0))
    if "pay" in has:
        extra["payz"] = F.nullif(F.col("pay"), F.lit(0.0))
    rows = rows.select("*", *[c.alias(n) for n, c in extra.items()])
    local: dict[str, Column] = {}
    if "bal" in has:
        local["bal_i"] = F.count("bal").over(upto) - 1
    if "payz" in extra:
        local["payz_i"] = F.count("payz").over(upto) - 1
    if "util0" in extra:
        local["util0_i"] = F.count("util0").over(upto) - 1
    if "was" in extra:
        local["healed"] = flag((F.lag("was", 1, 0).over(same_day) == 1) & (F.col("was") == 0))
    rows = rows.select("*", *[c.alias(n) for n, c in local.items()])

    def moments(x: str) -> list[Column]:
        return [
            F.count(x).alias(f"{x}_n"),
            F.sum(x).alias(f"{x}_s"),
            F.max(x).alias(f"{x}_hi"),
            F.min(x).alias(f"{x}_lo"),
            (F.var_pop(x) * F.count(x)).alias(f"{x}_m2"),
        ]

    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for x in ("dpd", "bal", "pay", "util", "util0", "payz", "p2d"):
        if x in has or x in extra:
            aggs += moments(x)
    for x in ("bal", "pay"):
        if x in has:
            order = F.when(F.col(x).isNotNull(), F.col("rid"))
            aggs += [F.min_by(x, order).alias(f"{x}_first"), F.max_by(x, order).alias(f"{x}_last")]
    for x in ("bal", "payz", "util0"):
        if f"{x}_i" in local:
            aggs.append(F.sum(F.col(x) * F.col(f"{x}_i")).alias(f"{x}_xy"))
    if "was" in extra:
        aggs += [
            F.sum("was").alias("late"),
            F.sum(flag(F.col("dpd") >= 30)).alias("ge30"),
            F.sum(flag(F.col("dpd") >= 60)).alias("ge60"),
            F.sum("healed").alias("healed_in"),
            F.min_by("was", "rid").alias("was_first"),
            F.max_by("was", "rid").alias("was_last"),
        ]
    if "under" in has:
        aggs.append(F.sum("under").alias("under"))
    for c in [*numeric, *flags]:
        aggs += [
            F.count(f"num_{c}").alias(f"num_{c}_n"),
            F.sum(f"num_{c}").alias(f"num_{c}_s"),
            F.max(f"num_{c}").alias(f"num_{c}_hi"),
            F.min(f"num_{c}").alias(f"num_{c}_lo"),
        ]
    state = rows.groupBy("ent", "ts").agg(*aggs)

    # Per customer: how many non-null values came before this date, and whether the arrears of the
    # previous date ended on this one.  One row per date here, so a heavy customer stays small.
    days = Window.partitionBy("ent").orderBy("ts")
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    carried: list[Column] = []
    for x in ("bal", "payz", "util0"):
        if f"{x}_i" in local:
            carried.append(F.coalesce(F.sum(f"{x}_n").over(before), F.lit(0)).alias(f"{x}_before"))
    if "was" in extra:
        ended = (F.lag("was_last", 1, 0).over(days) == 1) & (F.col("was_first") == 0)
        carried.append(flag(ended).alias("healed_cross"))
    return state.select("*", *carried)


def folded_application_time(history: DataFrame, cfg: HistoryConfig) -> Column:
    """Application time as far as the windows can tell it apart.

    Against whole statement days, every time of day behaves like noon: statements of the same day are in,
    and a window start inside a day leaves that day out.  Folding to midnight or noon keeps the number of
    distinct times of a heavy customer at two per day.
    """
    at = F.col(cfg.application_date).cast("timestamp_ntz")
    if not (cfg.day_grain or isinstance(history.schema[cfg.date].dataType, T.DateType)):
        return at
    day = F.date_trunc("day", at).cast("timestamp_ntz")
    noon = day + F.make_dt_interval(F.lit(0), F.lit(12))
    return F.when(at == day, day).otherwise(noon)


def point_in_time_pairs(states: DataFrame, applications: DataFrame, cfg: HistoryConfig) -> DataFrame:
    """Distinct (entity, application time) against the dated states inside the observation window."""
    keys = (
        applications.select("ent", "app_ts")
        .filter(F.col("ent").isNotNull() & F.col("app_ts").isNotNull())
        .distinct()
    )
    return join_dates(keys, states, cfg.observation_months)


def window_features(
    pairs: DataFrame, cfg: HistoryConfig, numeric: Sequence[str], flags: Sequence[str], only: set[str] | None = None
) -> DataFrame:
    """Trailing-window features per (entity, application time); ``only`` names the ones to declare."""
    cols = set(pairs.columns)
    lower = {k: F.col("ts") >= F.col("app_ts") - F.make_interval(F.lit(0), F.lit(k)) for k in cfg.windows}
    pairs = pairs.select("*", *[flag(lower[k]).alias(f"in_{k}") for k in cfg.windows])
    inside = {k: F.col(f"in_{k}") == 1 for k in cfg.windows}

    def pick(k: int, x: str | Column) -> Column:
        return F.when(inside[k], F.col(x) if isinstance(x, str) else x)

    # Window means come first: spreads and slopes are then taken around the mean, which keeps
    # precision when a window holds nearly equal large amounts.
    own = Window.partitionBy("ent", "app_ts")
    centred: list[Column] = []
    spread = [x for x in ("bal", "pay", "util0") if f"{x}_n" in cols]
    sloped = [x for x in ("bal", "payz", "util0") if f"{x}_before" in cols]
    around_mean = ("std", "cv", "slope", "volatility")
    if only is not None and not any(part in name for name in only for part in around_mean):
        spread, sloped = [], []
    for x in dict.fromkeys([*spread, *sloped]):
        for k in cfg.windows:
            total = F.sum(pick(k, f"{x}_s")).over(own)
            count = F.sum(pick(k, f"{x}_n")).over(own)
            centred.append((total / F.nullif(count, F.lit(0))).alias(f"{x}_mean_{k}"))
            if x in sloped:
                centred.append(F.min(pick(k, f"{x}_before")).over(own).alias(f"{x}_base_{k}"))
    pairs = pairs.select("*", *centred)

    aggs: list[Column] = []

    def add(name: str, make: Callable[[], Column]) -> None:
        if only is None or name in only:
            aggs.append(make().alias(name))

    def total(k: int, x) -> Column:
        return F.sum(pick(k, x))

    def mean(k: int, x: str) -> Column:
        return total(k, f"{x}_s") / F.nullif(total(k, f"{x}_n"), F.lit(0))

    def std(k: int, x: str) -> Column:
        m = F.col(f"{x}_mean_{k}")
        own_mean = F.col(f"{x}_s") / F.nullif(F.col(f"{x}_n"), F.lit(0))
        m2 = total(k, F.col(f"{x}_m2") + F.col(f"{x}_n") * (own_mean - m) * (own_mean - m))
        return F.sqrt(m2 / F.nullif(total(k, f"{x}_n"), F.lit(0)))

    def slope(k: int, x: str) -> Column:
        m = F.col(f"{x}_mean_{k}")
        n_d = F.col(f"{x}_n")
        shift = F.col(f"{x}_before") - F.col(f"{x}_base_{k}")
        around = shift * (F.col(f"{x}_s") - n_d * m) + F.col(f"{x}_xy") - m * n_d * (n_d - 1) / 2
        n = total(k, f"{x}_n").cast("double")
        line = total(k, around) * 12 / F.nullif(n * (n * n - 1), F.lit(0.0))
        return F.when(n >= 2, line).when(n >= 1, F.lit(0.0))

    def last(k: int, x: str) -> Column:
        return F.max_by(f"{x}_last", F.when(inside[k] & F.col(f"{x}_last").isNotNull(), F.col("ts")))

    def earliest(k: int, x: str) -> Column:
        return F.min_by(f"{x}_first", F.when(inside[k] & F.col(f"{x}_first").isNotNull(), F.col("ts")))

    widest = max(cfg.windows)
    add("credit_history_records", lambda: F.sum("n"))
    add("history_first_date", lambda: F.min("ts"))
    add("history_last_date", lambda: F.max("ts"))
    for c in numeric:
        add(f"{c}_mean_hist", lambda: F.sum(f"num_{c}_s") / F.nullif(F.sum(f"num_{c}_n"), F.lit(0)))
        add(f"{c}_max_hist", lambda: F.max(f"num_{c}_hi"))
        add(f"{c}_min_hist", lambda: F.min(f"num_{c}_lo"))
    for c in flags:
        add(f"{c}_sum_hist", lambda: F.sum(f"num_{c}_s"))
        add(f"{c}_rate_hist", lambda: F.sum(f"num_{c}_s") / F.nullif(F.sum(f"num_{c}_n"), F.lit(0)))
        add(f"{c}_max_hist", lambda: F.max(f"num_{c}_hi"))
    for k in cfg.windows:
        n = F.nullif(F.coalesce(total(k, "n"), F.lit(0)), F.lit(0))
        add(f"credit_history_records_{k}m", lambda: n)
        if "dpd_n" in cols:
            add(f"dpd_max_{k}m", lambda: F.max(pick(k, "dpd_hi")))
            add(f"dpd_mean_{k}m", lambda: mean(k, "dpd"))
            add(f"num_late_payments_{k}m", lambda: total(k, "late"))
            add(f"beh_dpd_cnt_gt0_{k}m", lambda: total(k, "late"))
            add(f"beh_dpd_cnt_ge30_{k}m", lambda: total(k, "ge30"))
            add(f"beh_dpd_cnt_ge60_{k}m", lambda: total(k, "ge60"))
            # A statement without a dpd counts as 0 in the behavioural maximum.
            filled = F.when(
                F.col("dpd_n") < F.col("n"), F.greatest(F.coalesce("dpd_hi", F.lit(0.0)), F.lit(0.0))
            ).otherwise(F.col("dpd_hi"))
            add(f"beh_dpd_max_{k}m", lambda: F.max(pick(k, filled)))
            add(f"beh_dpd_rate_{k}m", lambda: total(k, "late") / n)
            if k == widest:
                episodes = total(k, F.col("healed_in") + F.col("healed_cross"))
                # The first date of the window has no predecessor inside it.
                opening = F.min_by("healed_cross", F.when(inside[k], F.col("ts")))
                add(f"beh_recovery_episodes_{k}m", lambda: episodes - opening)
        if "util_n" in cols:
            add(f"utilization_avg_{k}m", lambda: mean(k, "util"))
            add(f"utilization_max_{k}m", lambda: F.max(pick(k, "util_hi")))
            add(f"beh_util_std_{k}m", lambda: F.when(n > 0, F.coalesce(std(k, "util0"), F.lit(0.0))))
            cv = F.coalesce(std(k, "util0") / F.nullif(mean(k, "util0"), F.lit(0.0)), F.lit(0.0))
            add(f"beh_util_cv_{k}m", lambda: F.when(n > 0, cv))
            if k >= 6:
                add(f"beh_util_slope_{k}m", lambda: slope(k, "util0"))
        if "p2d_n" in cols:
            add(f"payment_to_debt_ratio_{k}m", lambda: mean(k, "p2d"))
        if "bal_n" in cols and k == 6:
            count = total(k, "bal_n")
            change = last(k, "bal") - earliest(k, "bal")
            add(f"trend_balance_{k}m", lambda: F.when(count >= 2, change).when(count >= 1, F.lit(0.0)))
        if "pay_n" in cols and k == 6:
            add(f"volatility_payments_{k}m", lambda: std(k, "pay"))
        if "bal_n" in cols and "pay_n" in cols and k >= 6:
            add(f"beh_balance_slope_{k}m", lambda: slope(k, "bal"))
            if k == widest:
                add(f"beh_payment_slope_{k}m", lambda: slope(k, "payz"))
        for x, label in (("bal", "balance"), ("pay", "payment")):
            if f"{x}_n" in cols:
                add(f"beh_{label}_delta_{k}m", lambda: last(k, x) - mean(k, x))
                add(f"beh_{label}_std_{k}m", lambda: F.when(n > 0, F.coalesce(std(k, x), F.lit(0.0))))
                cv = F.coalesce(std(k, x) / F.nullif(mean(k, x), F.lit(0.0)), F.lit(0.0))
                add(f"beh_{label}_cv_{k}m", lambda: F.when(n > 0, cv))
        if "under" in cols:
            add(f"beh_underpayment_rate_{k}m", lambda: total(k, "under") / n)
    return pairs.groupBy("ent", "app_ts").agg(*aggs)


def history_features(
    history: DataFrame, applications: DataFrame, cfg: HistoryConfig = HistoryConfig(), only: Sequence[str] | None = None
) -> DataFrame:
    """One row per application with its history features (NULL where a window holds no statement)."""
    roles = HistoryColumns.of(history.columns)
    flags = [f"dpd_{t}_flag" for t in cfg.dpd_thresholds if f"dpd_{t}_flag" in history.columns]
    states = statement_states(history, cfg, roles)
    apps = applications.select(
        cfg.application_id, F.col(cfg.entity).alias("ent"), folded_application_time(history, cfg).alias("app_ts")
    )
    pairs = point_in_time_pairs(states, apps, cfg)
    features = window_features(pairs, cfg, list(cfg.numeric or []), flags, set(only) if only else None)
    return apps.join(features, ["ent", "app_ts"], "left").drop("ent", "app_ts")


def attach_features(applications: DataFrame, features: DataFrame, key: str = "application_id") -> DataFrame:
    return applications.join(features, key, "left")


# ---------------------------------------------------------------------------------------------------
# Per-customer summary of the whole history, cut at the application date.


def cut_at_application(history: DataFrame, applications: DataFrame, cfg: HistoryConfig) -> DataFrame:
    """Rows up to the customer's latest application date; customers without a date are dropped.

    A customer may apply several times; the last application is the one the map keeps, made explicit
    here as the latest date.
    """
    dates = applications.groupBy(cfg.entity).agg(F.max(cfg.application_date).alias("__cut"))
    return (
        history.join(dates, cfg.entity)
        .filter(F.col("__cut").isNotNull() & (F.col(cfg.date) <= F.col("__cut")))
        .drop("__cut")
    )


@dataclass(frozen=True)
class SummaryColumns:
    dpd: str | None
    balance: str | None
    due: str | None
    payment: str | None
    limit: str | None

    @classmethod
    def of(cls, columns: list[str]) -> "SummaryColumns":
        # Keyword lists of the customer summary.
        return cls(
            dpd=first_match(columns, ["dpd", "days_past_due"]),
            balance=first_match(columns, ["balance", "outstanding"]),
            due=first_match(columns, ["due", "installment", "due_amount"]),
            payment=first_match(columns, ["payment", "paid", "received"]),
            limit=first_match(columns, ["limit", "credit_limit"]),
        )


def with_summary_inputs(history: DataFrame, cfg: HistoryConfig) -> DataFrame:
    """Adds dpd value and flags, payment ratio, utilisation and past-due ratio."""
    c = SummaryColumns.of(history.columns)
    out: list[Column] = []
    if c.dpd:
        dpd = F.coalesce(as_double(history, c.dpd), F.lit(0.0))
        out.append(dpd.alias("dpd_value"))
        out += [flag(dpd >= t).alias(f"dpd_{t}_flag") for t in cfg.dpd_thresholds]
    if c.payment and c.due:
        out.append(safe_ratio(as_double(history, c.payment), as_double(history, c.due)).alias("payment_ratio"))
    if c.balance and c.limit:
        out.append(safe_ratio(as_double(history, c.balance), as_double(history, c.limit)).alias("utilization"))
    if c.balance and c.due:
        paid = as_double(history, c.payment) if c.payment else F.lit(0.0)
        rest = as_double(history, c.balance) - paid
        out.append(safe_ratio(rest, as_double(history, c.due)).alias("past_due_ratio"))
    return history.select("*", *out)


def customer_summary(history: DataFrame, cfg: HistoryConfig = HistoryConfig()) -> DataFrame:
    """Mean, max and sample deviation per customer plus dpd threshold counts; one combined pass."""
    rows = with_summary_inputs(history, cfg)
    aggs: list[Column] = []
    for x in ("dpd_value", "payment_ratio", "utilization", "past_due_ratio"):
        if x in rows.columns:
            aggs += [
                F.avg(x).alias(f"{x}_mean"),
                F.max(x).alias(f"{x}_max"),
                F.stddev_samp(x).alias(f"{x}_std"),
            ]
    for t in cfg.dpd_thresholds:
        f = f"dpd_{t}_flag"
        if f in rows.columns:
            aggs += [
                F.sum(f).alias(f"{f}_count"),
                F.avg(f).alias(f"{f}_share"),
                flag(F.avg(f) > 0.5).alias(f"{f}_chronic"),
            ]
    return rows.filter(F.col(cfg.entity).isNotNull()).groupBy(cfg.entity).agg(*aggs)


def latest_snapshot(rows: DataFrame, entity: str, date: str, tiebreak: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of each entity's last row; combines before the shuffle, unlike a row-number window."""
    order = F.struct(F.col(date).isNull(), F.col(date), *[F.col(c) for c in tiebreak])
    return (
        rows.filter(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(F.max_by(F.struct(*[F.col(c) for c in columns]), order).alias("last"))
        .select(entity, "last.*")
    )
