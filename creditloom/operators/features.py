"""Configurable feature factory.

The driver reads the specification and the column names and declares, for each family, what it needs:
totals per entity, trailing windows, totals per segment, and plain row expressions.  All entity totals
come from one grouping, all trailing windows share one partitioning and one sort, and the features are
written by a single final projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.expr import (
    as_double,
    clip,
    compare,
    finite,
    flag,
    numeric_columns,
    safe_ratio,
)
from creditloom.operators.rules import detection_features
from creditloom.plans.ranked import quantile_map
from creditloom.plans.slices import DEFAULT_LIMIT, SlicedFrame

# Statuses that count as an active loan.
ACTIVE_STATUSES = ("active", "current", "open", "1", "true")


@dataclass(frozen=True)
class EventMarker:
    column: str
    threshold: float = 1.0
    operator: str = ">="


@dataclass(frozen=True)
class BehavioralFlag:
    column: str
    threshold: float
    operator: str = ">="
    window: int | None = None


@dataclass(frozen=True)
class FeatureSpec:
    """The defaults below are the standard specification used when no config is given."""

    ratios: dict[str, list[str]] = field(
        default_factory=lambda: {
            "dti": ["total_debt", "monthly_income"],
            "utilization": ["current_balance", "credit_limit"],
            "payment_rate": ["payment_amount", "due_amount"],
        }
    )
    numeric_aggregations: dict[str, list[str]] = field(
        default_factory=lambda: {
            "payment_amount": ["mean", "max", "std"],
            "balance": ["mean", "max", "min", "std"],
            "due_amount": ["mean", "max"],
        }
    )
    rolling_windows: list[int] = field(default_factory=lambda: [3, 6, 12])
    trend_features: list[str] = field(default_factory=lambda: ["balance", "payment_amount", "utilization"])
    delinquency_markers: list[str] = field(default_factory=lambda: ["dpd_30_flag", "dpd_60_flag", "dpd_90_flag"])
    event_markers: dict[str, EventMarker] = field(
        default_factory=lambda: {"dpd_30": EventMarker("dpd_30_flag", 1), "dpd_60": EventMarker("dpd_60_flag", 1)}
    )
    behavioral_flags: dict[str, BehavioralFlag] = field(
        default_factory=lambda: {
            "credit_hungry": BehavioralFlag("new_credit_inquiries", 3, ">=", 6),
            "high_utilization": BehavioralFlag("utilization", 0.8, ">="),
        }
    )
    segment_normalization: dict[str, str] = field(default_factory=lambda: {"monthly_income": "region"})
    volatility_features: list[str] = field(default_factory=lambda: ["balance", "payment_amount"])
    time_since_event_cols: list[str] = field(default_factory=lambda: ["dpd_30_flag", "dpd_60_flag"])
    active_loan_indicator: str | None = "account_status"
    log_features: list[str] = field(default_factory=list)
    winsorize: dict[str, list[float]] = field(default_factory=dict)
    interaction_pairs: list[list[str]] = field(default_factory=list)

    @classmethod
    def from_config(cls, cfg: dict | None) -> "FeatureSpec":
        """Missing or empty entries keep their default."""
        if not cfg:
            return cls()
        given = {k: v for k, v in cfg.items() if k in cls.__dataclass_fields__}
        for name, kind in (("event_markers", EventMarker), ("behavioral_flags", BehavioralFlag)):
            marks = given.pop(name, None)
            if marks:
                given[name] = {
                    key: kind(**{**o, "threshold": float(o.get("threshold", 1.0))}) for key, o in marks.items()
                }
        return cls(**given)

    @classmethod
    def empty(cls, **only) -> "FeatureSpec":
        """A specification with just the given families."""
        blank: dict = {
            name: ([] if str(f.type).startswith("list") else {})
            for name, f in cls.__dataclass_fields__.items()
        }
        blank["active_loan_indicator"] = None
        return cls(**{**blank, **only})


AGGREGATES = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_samp,
    "count": F.count,
    "sum": F.sum,
}


class FeaturePlan:
    """Collects what the families need from one frame."""

    def __init__(self, df: DataFrame, spec: FeatureSpec, date: str | None, entity: str | None, tiebreak: Sequence[str]):
        self.df, self.spec = df, spec
        self.date = date if date in df.columns else None
        self.entity = entity if entity in df.columns else None
        self.tiebreak = list(tiebreak)
        # Name -> (statistic, what it is taken of).
        self.totals: dict[str, tuple[str, Column]] = {}
        self.trailing: dict[str, tuple[Column, int]] = {}
        self.segments: dict[str, set[str]] = {}
        self.features: dict[str, Column] = {}
        self.limits: dict[str, tuple[float, float]] = {}
        self.ordered_by = F.struct(
            *([F.col(self.date).isNull(), F.col(self.date)] if self.date else []), *[F.col(c) for c in self.tiebreak]
        )

    def has(self, *names: str) -> bool:
        return all(n in self.df.columns for n in names)

    def num(self, name: str) -> Column:
        return as_double(self.df, name)

    def total(self, key: str, stat: str, x: Column) -> Column:
        self.totals[f"__t_{key}"] = (stat, x)
        return F.col(f"__t_{key}")

    def aggregate(self, stat: str, x: Column) -> Column:
        if stat in ("first", "last"):
            return (F.min_by if stat == "first" else F.max_by)(x, self.ordered_by)
        return AGGREGATES[stat](x)

    def roll(self, name: str, window: int) -> Column:
        key = f"__r_{name}_{window}"
        self.trailing[key] = (self.num(name), window)
        return F.col(key)

    # -- families ------------------------------------------------------------------------------------

    def ratios(self) -> None:
        for name, pair in self.spec.ratios.items():
            if len(pair) == 2 and self.has(*pair):
                self.features[name] = safe_ratio(self.num(pair[0]), self.num(pair[1]))

    def entity_aggregates(self) -> None:
        if not self.entity:
            return
        for col, stats in self.spec.numeric_aggregations.items():
            if self.has(col):
                for s in stats:
                    self.features[f"{col}_{s}_by_{self.entity}"] = self.total(f"{col}_{s}", s, self.num(col))

    def rolling(self, columns: Sequence[str] | None = None) -> None:
        if not (self.entity and self.date):
            return
        skip = {self.entity, *self.tiebreak}
        names = list(columns) if columns is not None else [c for c in numeric_columns(self.df) if c not in skip]
        for w in self.spec.rolling_windows:
            for c in names:
                self.features[f"{c}_roll_mean_{w}"] = self.roll(c, w)

    def trends(self) -> None:
        if not (self.entity and self.date):
            return
        for col in self.spec.trend_features:
            if self.has(col):
                x = self.num(col)
                first = self.total(f"{col}_first", "first", x)
                last = self.total(f"{col}_last", "last", x)
                several = self.total("rows", "count", F.lit(1)) > 1
                change = last - first
                single = ~several  # NULL without an entity, so neither branch applies
                self.features[f"{col}_delta"] = F.when(several, change).when(single, F.lit(0.0))
                self.features[f"{col}_pct_change"] = F.when(several, change / (F.abs(first) + 1e-6)).when(single, F.lit(0.0))

    def delinquency(self) -> None:
        marks = [c for c in self.spec.delinquency_markers if self.has(c)]
        if marks:
            values = [F.coalesce(self.num(c), F.lit(0.0)) for c in marks]
            top = F.greatest(*values) if len(values) > 1 else values[0]
            self.features["delinq_sum"] = sum(values[1:], values[0])
            self.features["delinq_max"] = top
            self.features["delinq_any_30"] = flag(top > 0)

    def events(self) -> None:
        for name, m in self.spec.event_markers.items():
            if self.has(m.column):
                x = F.coalesce(self.num(m.column), F.lit(0.0))
                self.features[f"event_{name}"] = flag(compare(x, m.operator, m.threshold))

    def behaviour(self) -> None:
        for name, r in self.spec.behavioral_flags.items():
            if self.has(r.column):
                x = self.roll(r.column, r.window) if r.window and self.entity else self.num(r.column)
                self.features[f"behavior_{name}"] = flag(compare(x, r.operator, r.threshold))

    def segment_norm(self) -> None:
        for value, segment in self.spec.segment_normalization.items():
            if self.has(value, segment):
                self.segments.setdefault(segment, set()).add(value)
                mean = F.col(f"__s_{segment}_{value}")
                self.features[f"{value}_vs_{segment}"] = self.num(value) / (mean + 1e-6)

    def volatility(self) -> None:
        if not self.entity:
            return
        for col in self.spec.volatility_features:
            if self.has(col):
                std = F.coalesce(self.total(f"{col}_std", "std", self.num(col)), F.lit(0.0))
                mean = self.total(f"{col}_mean", "mean", self.num(col))
                known = F.col(self.entity).isNotNull()
                self.features[f"{col}_std"] = F.when(known, std)
                self.features[f"{col}_cv"] = F.when(known, std / F.nullif(mean, F.lit(0.0)))

    def time_since(self) -> None:
        if not (self.entity and self.date):
            return
        for col in self.spec.time_since_event_cols:
            if self.has(col):
                latest = self.total("last_date", "max", F.col(self.date))
                event = self.total(f"{col}_when", "max", F.when(self.num(col) > 0, F.col(self.date)))
                self.features[f"time_since_{col}"] = F.timestamp_diff("DAY", event, latest)

    def active_loans(self) -> None:
        col = self.spec.active_loan_indicator
        if col and self.entity and self.has(col):
            status = F.lower(F.col(col).cast("string"))
            active = self.total("active", "sum", flag(status.isin(*ACTIVE_STATUSES)))
            known = self.total("status", "count", F.col(col))
            self.features["active_loans_count"] = active
            self.features["active_loans_share"] = active / F.nullif(known, F.lit(0))

    def clock(self) -> None:
        turn = 2 * math.pi
        if self.has("application_hour"):
            h = self.num("application_hour")
            self.features["application_hour_sin"] = F.sin(h * turn / 24)
            self.features["application_hour_cos"] = F.cos(h * turn / 24)
            self.features["is_night"] = flag((h >= 21) | (h <= 6))
        if self.has("application_day_of_week"):
            d = self.num("application_day_of_week")
            self.features["is_weekend"] = flag(d.isin(5, 6))
            self.features["application_dow_sin"] = F.sin(d * turn / 7)
            self.features["application_dow_cos"] = F.cos(d * turn / 7)

    def logs(self) -> None:
        for col in self.spec.log_features:
            if self.has(col):
                self.features[f"{col}_log1p"] = F.log1p(clip(self.num(col), 0.0, None))

    def winsorized(self, bounds: dict[str, tuple[float, float]] | None = None) -> None:
        limits = {}
        for col, q in self.spec.winsorize.items():
            if self.has(col):
                low, high = ([*q, 0.01, 0.99])[:2] if isinstance(q, (list, tuple)) else (0.01, 0.99)
                limits[col] = (float(low), float(high))
        todo = {c: q for c, q in limits.items() if not bounds or c not in bounds}
        found = dict(bounds or {})
        for q in sorted(set(todo.values())):
            names = [c for c, own in todo.items() if own == q]
            found |= {c: tuple(b) for c, b in quantile_map(self.df, names, q).items()}
        self.limits = {c: found[c] for c in limits if c in found}
        for col in limits:
            if col in found:
                self.features[f"{col}_winsor"] = clip(self.num(col), *found[col])

    def interactions(self) -> None:
        for pair in self.spec.interaction_pairs:
            if len(pair) == 2 and self.has(*pair):
                a, b = pair
                x, y = self.num(a), self.num(b)
                self.features[f"{a}_x_{b}"] = x * y
                self.features[f"{a}_minus_{b}"] = x - y
                self.features[f"{a}_div_{b}"] = safe_ratio(x, y)

    # -- assembly ------------------------------------------------------------------------------------

    def declare(
        self, families: Sequence[str], rolling_columns: Sequence[str] | None = None, bounds: dict[str, tuple[float, float]] | None = None
    ) -> None:
        for family in families:
            if family == "rolling":
                self.rolling(rolling_columns)
            elif family == "winsorized":
                self.winsorized(bounds)
            else:
                getattr(self, family)()

    def run(self, limit_rows: int = DEFAULT_LIMIT) -> DataFrame:
        df = self.df
        if self.entity and (self.trailing or self.totals):
            sliced = SlicedFrame(df, self.entity, self.date, self.tiebreak, limit_rows)
            if self.trailing:
                lookback = max(w for _, w in self.trailing.values())

                def mean(x: Column, rows: int):
                    return lambda w: F.avg(x).over(w.rowsBetween(-(rows - 1), 0))

                sliced.trailing(lookback, {k: mean(x, w) for k, (x, w) in self.trailing.items()})
            if self.totals:
                totals = (
                    df.filter(F.col(self.entity).isNotNull())
                    .groupBy(self.entity)
                    .agg(*[self.aggregate(*t).alias(k) for k, t in self.totals.items()])
                )
                sliced.attach(totals)
            df = sliced.result()
        for segment in self.segments:
            df = df.join(self.segment_means(segment), segment, "left")
        return self.finish(df)

    def segment_means(self, segment: str) -> DataFrame:
        known = self.df.filter(F.col(segment).isNotNull()).groupBy(segment)
        return known.agg(*[F.avg(self.num(v)).alias(f"__s_{segment}_{v}") for v in sorted(self.segments[segment])])

    def finish(self, df: DataFrame) -> DataFrame:
        """The input columns and the features, once everything they need is a column of ``df``."""
        own = self.df.columns
        fresh = [
            (finite(c) if self._is_real(name) else c).alias(name)
            for name, c in self.features.items()
            if name not in own
        ]
        return df.select(*own, *fresh)

    def _is_real(self, name: str) -> bool:
        flags = ("event_", "behavior_", "is_", "delinq_any", "time_since_", "active_loans_count")
        return not name.startswith(flags)


FAMILIES = (
    "ratios",
    "entity_aggregates",
    "rolling",
    "trends",
    "delinquency",
    "events",
    "behaviour",
    "segment_norm",
    "volatility",
    "time_since",
    "active_loans",
    "clock",
    "logs",
    "winsorized",
    "interactions",
)


def build_features(
    df: DataFrame,
    spec: FeatureSpec | dict | None = None,
    date: str | None = None,
    entity: str | None = None,
    tiebreak: Sequence[str] = (),
    detection: bool = False,
    families: Sequence[str] = FAMILIES,
    rolling_columns: Sequence[str] | None = None,
    bounds: dict[str, tuple[float, float]] | None = None,
    limit_rows: int = DEFAULT_LIMIT,
    cuts: dict[str, float | None] | None = None,
) -> DataFrame:
    """The input columns plus every feature whose inputs exist.

    ``tiebreak`` names columns that order rows of one entity and date; ``bounds`` passes winsor limits and
    ``cuts`` rule cuts fitted elsewhere (for example on the training rows) instead of this frame's own quantiles.
    """
    if not isinstance(spec, FeatureSpec):
        spec = FeatureSpec.from_config(spec)
    plan = FeaturePlan(df, spec, date, entity, tiebreak)
    plan.declare(families, rolling_columns, bounds)
    if detection:
        plan.features |= detection_features(df, cuts)
    return plan.run(limit_rows)


# Name parts that mark a column as an identifier for interactions.
ID_PARTS = ("id", "ref", "code", "num")


def interaction_candidates(
    ranked: Sequence[tuple[str, float]],
    df: DataFrame,
    top_k: int = 12,
    min_spearman: float = 0.01,
    forbidden: Sequence[str] = (),
    suspicious: Sequence[str] = (),
    id_parts: Sequence[str] = ID_PARTS,
) -> list[str]:
    """Strongest usable features in rank order; ``ranked`` is ``(feature, spearman)`` sorted by strength."""
    strong = [f for f, s in ranked[: top_k * 2] if abs(s or 0.0) >= min_spearman][:top_k]
    numeric = set(numeric_columns(df))
    banned = {x.lower() for x in forbidden}
    return [
        f
        for f in strong
        if f in numeric
        and f.lower() not in banned
        and not any(part in f.lower() for part in id_parts)
        and f not in set(suspicious)
        and not f.startswith("ix_")
    ]


def smart_interactions(df: DataFrame, features: Sequence[str], max_pairs: int = 20) -> dict[str, Column]:
    """Product, both ratios and both differences for the first ``max_pairs`` pairs in rank order."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]][:max_pairs]
    out: dict[str, Column] = {}
    for a, b in pairs:
        x, y = as_double(df, a), as_double(df, b)
        out[f"ix_{a}_x_{b}"] = finite(x * y)
        out[f"ix_{a}_div_{b}"] = safe_ratio(x, y)
        out[f"ix_{b}_div_{a}"] = safe_ratio(y, x)
        out[f"ix_{a}_minus_{b}"] = x - y
        out[f"ix_{b}_minus_{a}"] = y - x
    return out
