"""Model metrics from one table of distinct scores.

AUC, average precision, KS, thresholds and lift all read the two-level ordered counts, so tied scores
count half, no task sees all rows, and several groups or models are measured in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.plans.ranked import value_table

CLIP = 1e-15


def score_table(df: DataFrame, target: str = "y", score: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    return value_table(df, [score], target, keys)


class _Counts:
    """Columns of the score table as doubles (built on use, so importing needs no session)."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name).cast("double")

    @property
    def neg(self) -> Column:
        return self.n - self.pos

    @property
    def neg_below(self) -> Column:
        return self.below - self.pos_below

    @property
    def neg_total(self) -> Column:
        return self.total - self.pos_total

    @property
    def hits(self) -> Column:
        """Positives with a score at or above the value."""
        return self.pos_total - self.pos_below

    @property
    def flagged(self) -> Column:
        """Rows with a score at or above the value."""
        return self.total - self.below


C = _Counts()


def auc_agg() -> Column:
    """Share of (bad, good) pairs ordered right, ties half; NULL with one class."""
    both = F.max(C.pos_total) * F.max(C.neg_total)
    return F.sum(C.pos * (C.neg_below + C.neg / 2)) / F.nullif(both, F.lit(0.0))


def ap_agg() -> Column:
    return F.sum(C.pos * C.hits / C.flagged) / F.nullif(F.max(C.pos_total), F.lit(0.0))


def cumulative_gap() -> Column:
    bad = (C.pos_below + C.pos) / F.greatest(C.pos_total, F.lit(1.0))
    good = (C.neg_below + C.neg) / F.greatest(C.neg_total, F.lit(1.0))
    return F.abs(bad - good)


def ks_curve(df: DataFrame, target: str = "y", score: str = "p") -> DataFrame:
    """Cumulative share of bads and goods at every distinct score."""
    return score_table(df, target, score).select(
        F.col("value").alias("score"),
        ((C.pos_below + C.pos) / F.greatest(C.pos_total, F.lit(1.0))).alias("cum_bad"),
        ((C.neg_below + C.neg) / F.greatest(C.neg_total, F.lit(1.0))).alias("cum_good"),
    )


def ordered_metrics(df: DataFrame, target: str = "y", score: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """``keys, roc_auc, gini, pr_auc, ks`` in one grouping."""
    t = score_table(df, target, score, keys).groupBy(*keys, "feature").agg(
        auc_agg().alias("roc_auc"), ap_agg().alias("pr_auc"), F.max(cumulative_gap()).alias("ks")
    )
    return t.select(*keys, "feature", "roc_auc", (2 * F.col("roc_auc") - 1).alias("gini"), "pr_auc", "ks")


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def unit_edges(bins: int) -> list[float]:
    return [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]


def unit_bin(p: Column, bins: int, include_one: bool = False) -> Column:
    """Equal bins of [0, 1), left-closed; p = 1 belongs to no bin unless asked for."""
    edges = unit_edges(bins)
    out = F.when(p < edges[0], F.lit(None).cast("int"))
    for i, e in enumerate(edges[1:]):
        out = out.when(p < e, F.lit(i))
    if include_one:
        out = out.when(p == 1.0, F.lit(bins - 1))
    return out


def reliability(df: DataFrame, target: str = "y", score: str = "p", bins: int = 10, include_one: bool = False) -> DataFrame:
    return (
        df.select(F.col(target).cast("double").alias("y"), F.col(score).alias("p"))
        .withColumn("bin", unit_bin(F.col("p"), bins, include_one))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_true"), F.avg("p").alias("mean_pred"))
    )


def calibration_error_aggs(y: Column, p: Column, bins: int) -> Column:
    """Weighted gap of observed and predicted rate over the bins, as one set of conditional sums."""
    number = unit_bin(p, bins)
    gaps = [F.abs(F.coalesce(F.sum(F.when(number == b, y - p)), F.lit(0.0))) for b in range(bins)]
    return sum(gaps[1:], gaps[0]) / F.count(F.lit(1))


def metric_report(df: DataFrame, target: str = "y", score: str = "p", keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """All seven metrics, one row per key combination."""
    y, p = F.col(target).cast("double"), F.col(score).cast("double")
    rows = df.filter(F.col(target).isNotNull() & F.col(score).isNotNull())
    pointwise = rows.groupBy(*keys, F.lit(score).alias("feature")).agg(
        F.avg(log_loss(y, p)).alias("logloss"),
        F.avg(brier(y, p)).alias("brier"),
        calibration_error_aggs(y, p, bins).alias("ece"),
    )
    return ordered_metrics(df, target, score, keys).join(pointwise, [*keys, "feature"]).drop("feature")


METRICS = ("roc_auc", "gini", "pr_auc", "ks", "logloss", "brier", "ece")


def as_rows(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, metric, value)``."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]
    return report.select(*keys, F.inline(F.array(*cells)))


def lift_curve(df: DataFrame, target: str = "y", score: str = "p", bins: int = 10) -> DataFrame:
    """Bad rate among the best-scored ``step, 2 step, ...`` rows and its ratio to the base rate.

    Rows with the same score share their group's bad rate, so the curve does not depend on row order.
    """
    t = score_table(df, target, score)
    step = F.greatest(F.floor(F.col("total") / bins), F.lit(1))
    above = F.col("total") - F.col("below") - F.col("n")
    first, last = F.floor(above / step) + 1, F.floor((above + F.col("n")) / step)
    pos_above = C.pos_total - C.pos_below - C.pos
    points = t.filter(last >= first).select(
        "*", F.explode(F.sequence(first, last)).alias("k"), above.alias("above"), step.alias("step")
    )
    depth = (F.col("k") * F.col("step")).cast("double")
    gain = (pos_above + (depth - F.col("above")) / C.n * C.pos) / depth
    return points.select(
        F.col("k").cast("int").alias("point"),
        depth.cast("long").alias("depth"),
        gain.alias("gain"),
        (gain / (C.pos_total / C.total + 1e-6)).alias("lift"),
    )


def fbeta(beta: float) -> Column:
    p, r = C.hits / C.flagged, C.hits / F.nullif(C.pos_total, F.lit(0.0))
    b2 = beta * beta
    return (1 + b2) * p * r / (b2 * p + r + 1e-6)


def best_thresholds(df: DataFrame, target: str = "y", score: str = "p", betas: Sequence[float] = (1.0, 2.0)) -> DataFrame:
    """Score that maximises F1/F2 (lowest on ties) and the plain F1/F2 there."""
    t = score_table(df, target, score)
    best, cells = [], []
    for b in betas:
        b2, name = b * b, f"f{int(b)}"
        plain = (1 + b2) * C.hits / ((1 + b2) * C.hits + b2 * (C.pos_total - C.hits) + (C.flagged - C.hits))
        order = F.struct(F.round(fbeta(b), 12), -F.col("value"))
        best.append(F.max_by(F.struct("value", plain.alias("f")), order).alias(name))
        cells.append(
            F.struct(
                F.lit(name).alias("metric"), F.col(f"{name}.value").alias("threshold"), F.col(f"{name}.f").alias("f_score")
            )
        )
    return t.agg(*best).select(F.inline(F.array(*cells)))
