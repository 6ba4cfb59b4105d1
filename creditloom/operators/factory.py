"""The feature factory fitted on training rows, and applied to rows one by one.

The factory of :mod:`features` takes totals per entity, trailing windows, segment means, winsor limits and rule
cuts from the frame it is given.  ``fit_factory`` learns all of them on the training rows:

* winsor limits and rule cuts are numbers,
* segment means are a table per segment column,
* every entity total becomes a mergeable state (counts, sums, means with squared deviations, extremes, and the first and last
  row by date and tiebreak), all from one grouping that combines before its shuffle,
* trailing windows keep an entity's last rows, one fewer than the widest window; they are ranked before the shuffle
  too, so an entity that owns a third of the rows sends a few rows a task.

``apply_factory`` joins the state by entity and segment and merges each row into its own copy: a new row sees the
training rows of its entity and itself, never the rows that are scored along with it.  So a row has the same features alone,
in a batch and in a stream.  An entity that training has not seen starts with the row itself; a row without an entity has no
totals and windows, as in training; an unknown segment has no mean.  Windows end at the row, so one that
is older than the kept rows, or has no date, sees fewer of them.  Rows are new ones: a training row given
again counts twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.features import FeaturePlan, FeatureSpec
from creditloom.operators.rules import detection_cuts, detection_features
from creditloom.plans.session import materialize


@dataclass
class FactoryState:
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)
    cuts: dict[str, float | None] = field(default_factory=dict)
    #: Segment column -> table of the segment and its means.
    segments: dict[str, DataFrame] = field(default_factory=dict)
    #: One row per entity: states of its totals and its last rows.
    entities: DataFrame | None = None


#: What a statistic keeps.
PARTS = {
    "mean": ("n", "sum"),
    "sum": ("n", "sum"),
    "count": ("n",),
    "min": ("min",),
    "max": ("max",),
    "std": ("n", "mean", "m2"),
    "first": ("first",),
    "last": ("last",),
}
TAIL = "__f_tail"


def _name(key: str, part: str) -> str:
    return f"__f_{key.removeprefix('__t_')}_{part}"


class StatePlan(FeaturePlan):
    """Declares the same features as :class:`FeaturePlan`; fits their state or merges rows into it."""

    def order_of(self, undated_first: bool = False) -> Column:
        """Totals take rows without a date as the last, windows as the first."""
        dated = []
        if self.date:
            known = F.col(self.date).isNotNull()
            dated = [(known if undated_first else ~known).alias("o0"), F.col(self.date).alias("o1")]
        return F.struct(*dated, *[F.col(c).alias(f"o{i}") for i, c in enumerate(self.tiebreak, 2)])

    def placed(self, x: Column) -> Column:
        return F.struct(self.order_of().alias("o"), x.alias("v"))

    def _part(self, part: str, x: Column) -> Column:
        return {
            "n": lambda: F.count(x),
            "sum": lambda: F.sum(x),
            "mean": lambda: F.avg(x),
            "m2": lambda: F.var_pop(x) * F.count(x),
            "min": lambda: F.min(x),
            "max": lambda: F.max(x),
            # As min_by and max_by do, rows whose value is missing count as well.
            "first": lambda: F.min(self.placed(x)),
            "last": lambda: F.max(self.placed(x)),
        }[part]()

    def windows(self) -> int:
        return max((w for _, w in self.trailing.values()), default=1) - 1

    def values(self) -> dict[str, Column]:
        """What the trailing windows average, by name."""
        return {key.rsplit("_", 1)[0].removeprefix("__r_"): x for key, (x, _) in self.trailing.items()}

    def fit(self) -> FactoryState:
        state = FactoryState(self.limits)
        state.segments = {s: materialize(self.segment_means(s), "segment") for s in self.segments}
        if not self.entity or not (self.totals or self.trailing):
            return state
        known = self.df.filter(F.col(self.entity).isNotNull())
        parts = {_name(key, part): self._part(part, x) for key, (stat, x) in self.totals.items() for part in PARTS[stat]}
        table = known.groupBy(self.entity).agg(F.count(F.lit(1)).alias("__f_rows"), *[c.alias(n) for n, c in parts.items()])
        if self.windows() > 0:
            held = F.struct(self.order_of(True).alias("o"), *[x.alias(n) for n, x in self.values().items()])
            last = Window.partitionBy(self.entity).orderBy(F.desc("held.o"))
            rows = known.select(self.entity, held.alias("held")).withColumn("place", F.row_number().over(last))
            rows = rows.filter(F.col("place") <= self.windows())
            tail = rows.groupBy(self.entity).agg(F.sort_array(F.collect_list("held")).alias(TAIL))
            table = table.join(tail, self.entity, "left")
        state.entities = materialize(table, "entities")
        return state

    def merged(self, key: str, stat: str, x: Column, held: set[str]) -> Column:
        """The statistic of the stored rows and the row at hand."""

        def kept(part: str) -> Column:
            return F.col(_name(key, part)) if _name(key, part) in held else F.lit(None)

        n0, one = F.coalesce(kept("n"), F.lit(0)).cast("long"), x.isNotNull().cast("long")
        n = n0 + one
        if stat == "count":
            return n
        if stat in ("sum", "mean"):
            total = F.coalesce(kept("sum"), F.lit(0)) + F.coalesce(x, F.lit(0))
            return F.when(n > 0, total / n if stat == "mean" else total)
        if stat in ("min", "max"):
            if _name(key, stat) not in held:
                return x
            return (F.least if stat == "min" else F.greatest)(kept(stat), x)
        if stat == "std":
            away = x - F.coalesce(kept("mean"), x)
            m2 = F.coalesce(kept("m2"), F.lit(0.0)) + F.when(one > 0, away * away * n0 / n).otherwise(0.0)
            return F.when(n > 1, F.sqrt(m2 / (n - 1)))
        own = self.placed(x)
        if _name(key, stat) not in held:
            return x
        return (F.least if stat == "first" else F.greatest)(kept(stat), own)["v"]

    def rolled(self, name: str, x: Column, window: int, held: set[str]) -> Column:
        if TAIL not in held or window < 2:
            return x
        before = F.filter(TAIL, lambda t: t["o"] < self.order_of(True))
        last = F.slice(before, F.greatest(F.size(before) - (window - 2), F.lit(1)), F.lit(window - 1))
        start = F.struct(F.coalesce(x, F.lit(0.0)).alias("s"), x.isNotNull().cast("long").alias("n"))

        def add(t: Column, row: Column) -> Column:
            v = row[name]
            return F.struct((t["s"] + F.coalesce(v, F.lit(0.0))).alias("s"), (t["n"] + v.isNotNull().cast("long")).alias("n"))

        mean = F.aggregate(last, start, add, lambda t: F.when(t["n"] > 0, t["s"] / t["n"]))
        return F.when(F.col(TAIL).isNull(), x).otherwise(mean)

    def apply(self, state: FactoryState) -> DataFrame:
        df = self.df
        if self.entity and (self.totals or self.trailing):
            held: set[str] = set()
            if state.entities is not None:
                held = set(state.entities.columns) - {self.entity}
                kind = df.schema[self.entity].dataType
                df = df.join(state.entities.withColumn(self.entity, F.col(self.entity).cast(kind)), self.entity, "left")
            known = F.col(self.entity).isNotNull()
            made = {key: F.when(known, self.merged(key, stat, x, held)) for key, (stat, x) in self.totals.items()}
            for key, (x, window) in self.trailing.items():
                name = key.rsplit("_", 1)[0].removeprefix("__r_")
                made[key] = F.when(known, self.rolled(name, x, window, held))
            df = df.select("*", *[c.alias(k) for k, c in made.items()])
        for segment, values in self.segments.items():
            means = state.segments.get(segment)
            if means is None:
                df = df.select("*", *[F.lit(None).cast("double").alias(f"__s_{segment}_{v}") for v in values])
            else:
                kind = self.df.schema[segment].dataType
                df = df.join(means.withColumn(segment, F.col(segment).cast(kind)), segment, "left")
        return self.finish(df)


def fit_factory(
    train: DataFrame,
    spec: FeatureSpec,
    date: str | None,
    entity: str | None,
    tiebreak: Sequence[str],
    families: Sequence[str],
    rolling_columns: Sequence[str] | None = None,
    detection: bool = False,
) -> FactoryState:
    """The state of the factory on the training rows."""
    plan = StatePlan(train, spec, date, entity, tiebreak)
    plan.declare(families, rolling_columns)
    state = plan.fit()
    if detection:
        state.cuts = detection_cuts(train)
    return state


def apply_factory(
    df: DataFrame,
    state: FactoryState,
    spec: FeatureSpec,
    date: str | None,
    entity: str | None,
    tiebreak: Sequence[str],
    families: Sequence[str],
    rolling_columns: Sequence[str] | None = None,
    detection: bool = False,
) -> DataFrame:
    """The input columns and the features of new rows, each from the state and the row itself."""
    plan = StatePlan(df, spec, date, entity, tiebreak)
    # A column whose limits were not learnt has no winsor copy.
    learnt = {c: q for c, q in spec.winsorize.items() if c in state.limits}
    plan.spec = FeatureSpec(**{**vars(spec), "winsorize": learnt})
    plan.declare(families, rolling_columns, state.limits)
    if detection:
        plan.features |= detection_features(df, state.cuts)
    return plan.apply(state)
