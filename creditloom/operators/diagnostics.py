"""Single-feature strength, leakage verdicts and rankings.

All features are measured together from one table of (feature, distinct value) counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.expr import as_double, correlation
from creditloom.operators.metrics import auc_agg
from creditloom.operators.stats import long_levels
from creditloom.operators.woe import mutual_information
from creditloom.plans.ranked import average_rank, value_table

FEW_LEVELS = 500


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """``(level, code)``: position of each distinct text in sorted order.

    Ordered in two levels: texts are grouped by the two characters after their common prefix, numbered
    inside the group, and shifted by the sizes of the groups before.
    """
    levels = df.select(F.col(column).cast("string").alias("level")).filter(F.col("level").isNotNull()).distinct()
    ends = levels.agg(F.min("level").alias("a"), F.max("level").alias("b")).first()
    common = 0
    if ends["a"] is not None:
        while common < min(len(ends["a"]), len(ends["b"])) and ends["a"][common] == ends["b"][common]:
            common += 1
    keyed = levels.withColumn("head", F.substring("level", common + 1, 2))
    sizes = keyed.groupBy("head").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(1)).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("head", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy("head").orderBy("level")) - 1
    return keyed.select("head", "level", inside.alias("__i")).join(offsets, "head").select(
        "level", (F.col("__off") + F.col("__i")).cast("double").alias("code")
    )


def encode_for_diagnostics(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Numbers stay, booleans become 0/1, text that parses to two or more numbers is parsed, other text
    becomes its sorted code."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in columns if isinstance(kinds[c], T.StringType)]
    codes: dict[str, Column] = {}
    if text:
        checks: list[Column] = []
        for c in text:
            number = F.col(c).try_cast("double")
            checks += [(F.min(number) < F.max(number)).alias(f"{c}|num"), F.approx_count_distinct(c).alias(f"{c}|n")]
        seen = df.agg(*checks).first()
        few = [c for c in text if not seen[f"{c}|num"] and seen[f"{c}|n"] <= FEW_LEVELS]
        levels: dict[str, list[str]] = {c: [] for c in few}
        if few:
            for r in long_levels(df, few).filter(F.col("level").isNotNull()).distinct().collect():
                levels[r["feature"]].append(r["level"])
        for c in text:
            if seen[f"{c}|num"]:
                codes[c] = as_double(df, c)
            elif c in levels:
                pairs = [F.lit(v) for i, level in enumerate(sorted(levels[c])) for v in (level, float(i))]
                codes[c] = F.try_element_at(F.create_map(*pairs), F.col(c)) if pairs else F.lit(None).cast("double")
            else:
                renamed = level_codes(df, c).select(F.col("level").alias(c), F.col("code").alias(f"__code_{c}"))
                df = df.join(renamed, c, "left")
                codes[c] = F.col(f"__code_{c}")
    return df.select(*keep, *[codes.get(c, as_double(df, c) if c not in codes else None).alias(c) for c in columns])


def feature_stats(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """One row per feature of encoded numeric columns.

    ``n, distinct, auc, spearman, deterministic``; the guards for tiny or constant inputs are applied.
    """
    t = value_table(df, columns, target)
    n, total, p = (F.col(c).cast("double") for c in ("n", "total", "pos_total"))
    centred = average_rank() - (total + 1) / 2
    sxx = F.sum(n * centred * centred)
    sxy = F.sum((F.col("pos") - n * p / total) * centred)
    syy = F.max(p * (total - p) / total)
    usable = (F.max("total") >= 20) & (F.count(F.lit(1)) >= 2) & (F.max("pos_total") > 0) & (F.max("pos_total") < F.max("total"))
    rank_ok = (F.max("total") >= 10) & (sxx > 0) & (syy > 0)
    mixed = F.max(((F.col("pos") > 0) & (F.col("pos") < F.col("n"))).cast("int"))
    return t.groupBy("feature").agg(
        F.max("total").alias("n"),
        F.count(F.lit(1)).alias("distinct"),
        F.when(usable, auc_agg()).otherwise(F.lit(0.5)).alias("auc"),
        F.when(rank_ok, sxy / F.sqrt(sxx * syy)).otherwise(F.lit(0.0)).alias("spearman"),
        (mixed == 0).cast("int").alias("deterministic"),
    )


def feature_moments(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``(feature, rows, std, corr)``: one pass, correlation 0 where a side is constant."""
    y = F.col(target).cast("double")
    aggs: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        aggs += [F.stddev_samp(c).alias(f"s{i}"), correlation(F.col(c), y).alias(f"c{i}")]
    row = df.agg(*aggs)
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col("__rows").alias("rows"),
            F.col(f"s{i}").alias("std"),
            F.coalesce(F.col(f"c{i}"), F.lit(0.0)).alias("corr"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*cells)))


@dataclass(frozen=True)
class SelectionConfig:
    """The default limits of the feature checks."""

    suspicious_auc: float = 0.98
    weak_auc_tolerance: float = 0.02
    low_variance_ratio: float = 0.001
    min_spearman: float = 0.01
    drop_weak: bool = False
    drop_weak_spearman: bool = False
    report_top_k: int = 20


def diagnose(
    train: DataFrame,
    valid: DataFrame | None,
    columns: Sequence[str],
    target: str,
    cfg: SelectionConfig = SelectionConfig(),
    with_mi: bool = False,
) -> DataFrame:
    """One row per feature with its strength on both splits, the verdict flags and whether to drop it."""
    fit = encode_for_diagnostics(train, columns, [target])
    out = feature_moments(fit, columns, target).join(
        feature_stats(fit, columns, target).withColumnRenamed("auc", "auc_train"), "feature", "left"
    )
    if valid is not None:
        seen = [c for c in columns if c in valid.columns]
        check = encode_for_diagnostics(valid, seen, [target])
        other = feature_stats(check, seen, target).select("feature", F.col("auc").alias("auc_valid"))
        out = out.join(other, "feature", "left")
    else:
        out = out.withColumn("auc_valid", F.lit(None).cast("double"))
    if with_mi:
        out = out.join(mutual_information(fit, columns, target), "feature", "left")
    out = out.withColumn("auc_train", F.coalesce("auc_train", F.lit(0.5))).withColumn(
        "spearman", F.coalesce("spearman", F.lit(0.0))
    )
    ratio = F.coalesce("distinct", F.lit(0)) / F.greatest(F.col("rows"), F.lit(1))
    low = (ratio <= cfg.low_variance_ratio) | F.coalesce(F.col("std") == 0, F.lit(False))
    suspicious = (
        (F.col("auc_train") >= cfg.suspicious_auc)
        | F.coalesce(F.col("auc_valid") >= cfg.suspicious_auc, F.lit(False))
        | F.coalesce(F.col("deterministic") == 1, F.lit(False))
    )
    tol = cfg.weak_auc_tolerance
    weak = (F.abs(F.col("auc_train") - 0.5) <= tol) & F.coalesce(F.abs(F.col("auc_valid") - 0.5) <= tol, F.lit(True))
    weak_rank = F.abs("spearman") < cfg.min_spearman
    drop = low | suspicious
    if cfg.drop_weak:
        drop = drop | weak
    if cfg.drop_weak_spearman:
        drop = drop | weak_rank
    return out.select(
        "feature",
        "auc_train",
        "auc_valid",
        "corr",
        "spearman",
        ratio.alias("unique_ratio"),
        *(["mutual_info"] if with_mi else []),
        low.cast("int").alias("low_variance"),
        suspicious.cast("int").alias("suspicious"),
        weak.cast("int").alias("weak_auc"),
        weak_rank.cast("int").alias("weak_spearman"),
        drop.cast("int").alias("drop"),
    )


def top_features(stats: DataFrame, by: str, k: int = 20, absolute: bool = False) -> DataFrame:
    key = F.abs(F.col(by)) if absolute else F.col(by)
    return stats.orderBy(key.desc(), F.col("feature")).limit(k)
