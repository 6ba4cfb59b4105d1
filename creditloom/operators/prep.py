"""Fit/transform preprocessing.

A fit is a fixed number of aggregations whose results are small (one row per numeric column, at most
1 / rare_threshold levels per categorical column) and lives on the driver; a transform is one projection.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.clean import date_epoch, parse_currency
from creditloom.functions.expr import as_double, clip, containing, numeric_columns, text_columns
from creditloom.operators.stats import adjusted_skewness, class_weights, modes
from creditloom.operators.woe import WoeModel
from creditloom.plans.ranked import quantile_map

# Tokens written for missing, empty and rare levels.
MISSING, EMPTY, OTHER = "__missing__", "__empty__", "__other__"


@dataclass(frozen=True)
class PrepConfig:
    target: str = "default"
    id_col: str = "customer_ref"
    drop: Sequence[str] = ()
    numeric: Sequence[str] | None = None
    categorical: Sequence[str] | None = None
    winsor: tuple[float, float] = (0.01, 0.99)
    log_skew: float = 1.0
    rare: float = 0.01
    encoding: str = "frequency"
    smoothing: float = 20.0
    min_samples: int = 100
    woe: bool = False
    woe_features: Sequence[str] | None = None
    scale: bool = False
    keep_id: bool = True


@dataclass
class NumericState:
    median: float | None
    lower: float | None
    upper: float | None
    skew: float | None
    log: bool
    shift: float
    mean: float | None
    std: float | None


@dataclass
class CategoryState:
    levels: list[str]
    frequency: dict[str, float]
    target: dict[str, float]


def normal_level(x: Column) -> Column:
    text = F.lower(F.trim(x.cast("string")))
    return F.when(x.isNull(), F.lit(MISSING)).when(text == "", F.lit(EMPTY)).otherwise(text)


def fit_numeric(df: DataFrame, columns: Sequence[str], winsor=(0.01, 0.99), log_skew: float = 1.0) -> dict[str, NumericState]:
    if not columns:
        return {}
    view = df.select(*[as_double(df, c).alias(c) for c in columns])
    aggs: list[Column] = []
    for i, c in enumerate(columns):
        aggs += [
            adjusted_skewness(c).alias(f"skew{i}"),
            F.min(c).alias(f"min{i}"),
            F.avg(c).alias(f"mean{i}"),
            F.count(c).alias(f"n{i}"),
            F.stddev_pop(c).alias(f"std{i}"),
        ]
    row = view.agg(*aggs).first()
    most = max(row[f"n{i}"] for i in range(len(columns)))
    cuts = quantile_map(view, list(columns), [0.5, *winsor], rows=most)
    out = {}
    for i, c in enumerate(columns):
        median, lower, upper = cuts.get(c, (None, None, None))
        skew, low = row[f"skew{i}"], row[f"min{i}"]
        log = skew is not None and abs(skew) >= log_skew
        shift = abs(low) + 1 if log and low is not None and low <= 0 else 0.0
        out[c] = NumericState(median, lower, upper, skew, log, shift, row[f"mean{i}"], row[f"std{i}"])
    return out


def numeric_expressions(df: DataFrame, state: dict[str, NumericState], scale: bool = False) -> list[Column]:
    out: list[Column] = []
    for c, s in state.items():
        x = as_double(df, c) if c in df.columns else F.lit(None).cast("double")
        y = x if s.median is None else F.coalesce(x, F.lit(s.median))
        y = clip(y, s.lower, s.upper) if s.lower is not None else y
        if s.log:
            y = F.log1p(y + s.shift)
        if scale and s.std:
            y = (y - s.mean) / (s.std + 1e-6)
        out += [x.isNull().cast("int").alias(f"{c}_was_missing"), y.alias(c)]
    return out


def level_counts(df: DataFrame, columns: Sequence[str], target: str, rare: float) -> DataFrame:
    """``(feature, level, n, bad)`` after rare levels are folded into the other token."""
    cells = [F.struct(F.lit(c).alias("feature"), normal_level(F.col(c)).alias("level")) for c in columns]
    counts = (
        df.select(F.col(target).cast("double").alias("y"), F.inline(F.array(*cells)))
        .groupBy("feature", "level")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"), F.count("y").alias("n_y"))
    )
    totals = counts.groupBy("feature").agg(F.sum("n").alias("__t"))
    keep = (F.col("n") / F.col("__t") >= rare) | F.col("level").isin(MISSING, EMPTY)
    folded = counts.join(totals, "feature").withColumn("level", F.when(keep, F.col("level")).otherwise(F.lit(OTHER)))
    return folded.groupBy("feature", "level").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.sum("n_y").alias("n_y"), F.first("__t").alias("total")
    )


def fit_categories(
    df: DataFrame, columns: Sequence[str], target: str, rare: float = 0.01, smoothing: float = 20.0, prior: float | None = None
) -> dict[str, CategoryState]:
    if not columns:
        return {}
    if prior is None:
        prior = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    out = {c: CategoryState([], {}, {}) for c in columns}
    for r in level_counts(df, columns, target, rare).collect():
        s = out[r["feature"]]
        s.frequency[r["level"]] = r["n"] / r["total"]
        s.target[r["level"]] = (r["bad"] + smoothing * prior) / (r["n_y"] + smoothing)
    for s in out.values():
        s.levels = sorted({*s.frequency, MISSING, EMPTY, OTHER})
        s.target.setdefault(OTHER, prior)
    return out


def known_level(x: Column, state: CategoryState) -> Column:
    level = normal_level(x)
    allowed = [v for v in state.levels if v != OTHER]
    return F.when(level.isin(*allowed), level).otherwise(F.lit(OTHER))


def lookup(level: Column, table: dict[str, float], default: float) -> Column:
    pairs = [F.lit(v) for kv in sorted(table.items()) for v in kv]
    found = F.try_element_at(F.create_map(*pairs), level) if pairs else F.lit(None).cast("double")
    return F.coalesce(found, F.lit(float(default)))


def category_expressions(
    df: DataFrame, state: dict[str, CategoryState], encoding: str, prior: float
) -> list[Column]:
    out: list[Column] = []
    for c, s in state.items():
        x = F.col(c) if c in df.columns else F.lit(None).cast("string")
        level = known_level(x, s)
        out.append((level == MISSING).cast("int").alias(f"{c}_was_missing"))
        if encoding == "onehot":
            out += [(level == v).cast("int").alias(f"{c}_{v}") for v in s.levels]
        elif encoding == "frequency":
            out.append(lookup(level, s.frequency, s.frequency.get(OTHER, 0.0)).alias(f"{c}_freq"))
        elif encoding == "target":
            out.append(lookup(level, s.target, prior).alias(f"{c}_target"))
        else:
            raise ValueError(f"unknown categorical encoding {encoding!r}")
    return out


@dataclass
class PrepModel:
    config: PrepConfig
    numeric: dict[str, NumericState]
    categories: dict[str, CategoryState]
    prior: float
    weights: dict[int, float]
    woe: WoeModel | None = None

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        first = [self.config.id_col] if self.config.keep_id and self.config.id_col in df.columns else []
        columns = [
            *numeric_expressions(df, self.numeric, self.config.scale),
            *category_expressions(df, self.categories, self.config.encoding.lower(), self.prior),
        ]
        made = df.select(*[F.col(c) for c in [*first, *[k for k in keep if k not in first]]], *columns)
        return self.woe.transform(made) if self.woe else made

    @property
    def feature_names(self) -> list[str]:
        """Output columns, from the state alone."""
        names = [self.config.id_col] if self.config.keep_id else []
        for c in self.numeric:
            names += [f"{c}_was_missing", c]
        for c, s in self.categories.items():
            names.append(f"{c}_was_missing")
            tails = {"onehot": s.levels, "frequency": ["freq"], "target": ["target"]}[self.config.encoding.lower()]
            names += [f"{c}_{t}" for t in tails]
        return names + [f"{c}_woe" for c in (self.woe.features if self.woe else [])]

    def save(self, spark: SparkSession, path: str) -> None:
        state = {
            "config": asdict(self.config),
            "numeric": {c: asdict(s) for c, s in self.numeric.items()},
            "categories": {c: asdict(s) for c, s in self.categories.items()},
            "prior": self.prior,
            "weights": {str(k): w for k, w in self.weights.items()},
            "woe": asdict(self.woe) if self.woe else None,
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PrepModel":
        state = json.loads("".join(r[0] for r in spark.read.text(path).collect()))
        woe = state["woe"]
        return cls(
            PrepConfig(**{**state["config"], "winsor": tuple(state["config"]["winsor"])}),
            {c: NumericState(**s) for c, s in state["numeric"].items()},
            {c: CategoryState(**s) for c, s in state["categories"].items()},
            state["prior"],
            {int(k): w for k, w in state["weights"].items()},
            WoeModel(woe["edges"], {c: {int(b): v for b, v in m.items()} for c, m in woe["woe"].items()}) if woe else None,
        )


def fit_prep(df: DataFrame, cfg: PrepConfig) -> PrepModel:
    out = {cfg.target, cfg.id_col, *cfg.drop}
    numeric = [c for c in (cfg.numeric or numeric_columns(df)) if c in df.columns and c not in out]
    text = [c for c in (cfg.categorical or text_columns(df)) if c in df.columns and c not in out]
    classes = class_weights(df, cfg.target).collect()
    weights = {int(r[cfg.target]): r["weight"] for r in classes}
    total = sum(r["n"] for r in classes)
    prior = sum(float(r[cfg.target]) * r["n"] for r in classes) / total
    states = fit_numeric(df, numeric, cfg.winsor, cfg.log_skew)
    levels = fit_categories(df, text, cfg.target, cfg.rare, cfg.smoothing, prior)
    model = PrepModel(cfg, states, levels, prior, weights)
    if cfg.woe and numeric:
        wanted = [c for c in (cfg.woe_features or numeric) if c in states]
        if wanted:
            processed = df.select(F.col(cfg.target).alias("__y"), *numeric_expressions(df, states, cfg.scale))
            model.woe = WoeModel.fit(processed, wanted, "__y", bins=5, min_samples=cfg.min_samples, rows=total)
    return model


# -- single encoders ------------------------------------------------------------------------------------


def sigmoid_target_table(
    df: DataFrame, column: str, target: str, prior: float, smoothing: float = 10.0, min_leaf: int = 50, keys: Sequence[str] = ()
) -> DataFrame:
    """Level mean shrunk to the prior by a logistic weight of the level's size."""
    stats = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column, *keys)
        .agg(F.avg(F.col(target).cast("double")).alias("__m"), F.count(target).alias("__n"))
    )
    w = 1 / (1 + F.exp(-(F.col("__n") - min_leaf) / F.lit(float(smoothing))))
    return stats.select(column, *keys, (F.lit(prior) * (1 - w) + F.col("__m") * w).alias(f"{column}_encoded"))


def encode_sigmoid_target(
    df: DataFrame, columns: Sequence[str], target: str, smoothing: float = 10.0, min_leaf: int = 50, fit_on: DataFrame | None = None
) -> DataFrame:
    """Join each column's table back; levels are unbounded, so Spark picks the join by the table's size."""
    source = fit_on if fit_on is not None else df
    prior = source.agg(F.avg(F.col(target).cast("double"))).first()[0]
    for c in columns:
        df = df.join(sigmoid_target_table(source, c, target, prior, smoothing, min_leaf), c, "left")
    made = [F.coalesce(f"{c}_encoded", F.lit(prior)).alias(f"{c}_encoded") for c in columns]
    return df.select(*[c for c in df.columns if not c.endswith("_encoded")], *made)


def encode_target_out_of_fold(
    df: DataFrame, column: str, target: str, fold: Column, smoothing: float = 10.0, min_leaf: int = 50
) -> DataFrame:
    """Like the sigmoid encoder, but each row's level statistics leave out the row's own fold.

    ``fold`` numbers the rows, for example ``hash_fold(key, 5)``.
    """
    marked = df.withColumn("__fold", fold)
    prior = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    per = (
        marked.filter(F.col(column).isNotNull())
        .groupBy(column, "__fold")
        .agg(F.sum(F.col(target).cast("double")).alias("__s"), F.count(target).alias("__n"))
    )
    whole = per.groupBy(column).agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
    rest = per.join(whole, column).select(
        column, "__fold", (F.col("__ts") - F.col("__s")).alias("__os"), (F.col("__tn") - F.col("__n")).alias("__on")
    )
    w = 1 / (1 + F.exp(-(F.col("__on") - min_leaf) / F.lit(float(smoothing))))
    value = F.lit(prior) * (1 - w) + F.col("__os") / F.nullif(F.col("__on"), F.lit(0)) * w
    table = rest.select(column, "__fold", value.alias(f"{column}_encoded"))
    out = marked.join(table, [column, "__fold"], "left").drop("__fold")
    return out.withColumn(f"{column}_encoded", F.coalesce(f"{column}_encoded", F.lit(prior)))


@dataclass(frozen=True)
class Capper:
    """Quantile bounds fitted on one frame and applied to any."""

    bounds: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> "Capper":
        return cls({c: (q[0], q[1]) for c, q in quantile_map(df, columns, [lower, upper]).items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(
            *[clip(as_double(df, c), *self.bounds[c]).alias(c) if c in self.bounds else F.col(c) for c in df.columns]
        )


# -- column roles and the classic pipeline --------------------------------------------------------------

# Name tokens of currency columns.
CURRENCY_TOKENS = ("amt", "amount", "sum", "uzs", "payment")


@dataclass(frozen=True)
class ColumnRoles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    currency: list[str] = field(default_factory=list)


def column_roles(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> ColumnRoles:
    return ColumnRoles(
        numeric=sorted({*numeric_columns(df), *numeric}),
        categorical=sorted({*text_columns(df), *categorical}),
        datetime=containing(df.columns, "date"),
        currency=containing(df.columns, *CURRENCY_TOKENS),
    )


@dataclass
class ClassicModel:
    roles: ColumnRoles
    medians: dict[str, float]
    bounds: dict[str, tuple[float, float]]
    moments: dict[str, tuple[float, float]]
    modes: dict[str, str]
    levels: dict[str, list[str]]
    money_medians: dict[str, float]
    money_moments: dict[str, tuple[float, float]]

    def _number(self, df: DataFrame, c: str) -> Column:
        x = F.coalesce(as_double(df, c), F.lit(self.medians[c]))
        return clip(x, *self.bounds[c])

    def _money(self, c: str) -> Column:
        return F.coalesce(parse_currency(F.col(c)), F.lit(self.money_medians[c]))

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out: list[Column] = [F.col(k) for k in keep]
        for c in self.roles.numeric:
            m, s = self.moments[c]
            out.append(((self._number(df, c) - m) / (s or 1.0)).alias(c))
        for c in self.roles.categorical:
            level = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))
            out += [(level == v).cast("int").alias(f"{c}_{v}") for v in self.levels[c]]
        out += [date_epoch(F.col(c)).alias(f"{c}_epoch") for c in self.roles.datetime]
        for c in self.roles.currency:
            m, s = self.money_moments[c]
            out.append(((self._money(c) - m) / (s or 1.0)).alias(f"{c}_money"))
        return df.select(*out)


MAX_ONEHOT = 1000


def _moments(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float, float]]:
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(x).alias(f"m_{c}") for c, x in columns.items()], *[F.stddev_pop(x).alias(f"s_{c}") for c, x in columns.items()]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def fit_classic(df: DataFrame, roles: ColumnRoles) -> ClassicModel:
    """Median impute, cap, standardise; mode impute, one-hot; epoch dates; parsed money.

    One-hot makes a column per level, so a column with more than ``MAX_ONEHOT`` levels is refused:
    encode it by target instead.
    """
    numeric = df.select(*[as_double(df, c).alias(c) for c in roles.numeric])
    medians = {c: q[0] for c, q in quantile_map(numeric, roles.numeric, [0.5]).items()}
    filled = numeric.select(*[F.coalesce(c, F.lit(medians[c])).alias(c) for c in roles.numeric])
    bounds = {c: (q[0], q[1]) for c, q in quantile_map(filled, roles.numeric, [0.01, 0.99]).items()}
    moments = _moments(filled, {c: clip(F.col(c), *bounds[c]) for c in roles.numeric})
    top = {r["feature"]: r["mode"] for r in modes(df, roles.categorical).collect()} if roles.categorical else {}
    levels: dict[str, list[str]] = {}
    if roles.categorical:
        sizes = df.agg(*[F.count_distinct(c).alias(c) for c in roles.categorical]).first()
        wide = [c for c in roles.categorical if sizes[c] > MAX_ONEHOT]
        if wide:
            raise ValueError(f"too many levels for one-hot columns: {wide}")
        for c in roles.categorical:
            levels[c] = sorted(r[0] for r in df.select(F.col(c).cast("string")).dropna().distinct().collect())
    parsed = df.select(*[parse_currency(F.col(c)).alias(c) for c in roles.currency]) if roles.currency else None
    money_medians = {c: q[0] for c, q in quantile_map(parsed, roles.currency, [0.5]).items()} if parsed is not None else {}
    money = {c: F.coalesce(F.col(c), F.lit(money_medians[c])) for c in roles.currency}
    money_moments = _moments(parsed, money) if parsed is not None else {}
    return ClassicModel(roles, medians, bounds, moments, top, levels, money_medians, money_moments)
