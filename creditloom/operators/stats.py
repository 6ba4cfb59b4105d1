"""Descriptive aggregates: shares, modes, class weights, describe tables, histograms, monthly counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.plans.ranked import exact_quantiles


def long_levels(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., feature, level)`` with every column as text."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells)))


def value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share of every non-null level."""
    counts = (
        long_levels(df, columns).filter(F.col("level").isNotNull()).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("feature").agg(F.sum("n").alias("__t"))
    return counts.join(totals, "feature").select("feature", "level", "n", (F.col("n") / F.col("__t")).alias("share"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent level per column; the smallest level on ties."""
    counts = (
        long_levels(df, columns).filter(F.col("level").isNotNull()).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("feature").agg(F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("mode"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    return counts.select(
        target, "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight")
    )


def adjusted_skewness(x: str | Column) -> Column:
    """Sample skewness with the small-sample factor; NULL below three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def describe(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max, distinct levels, top level, its count."""
    aggs: list[Column] = []
    for c in numeric:
        aggs += [
            F.count(c).alias(f"{c}|count"),
            F.avg(c).alias(f"{c}|mean"),
            F.stddev_samp(c).alias(f"{c}|std"),
            F.min(c).cast("double").alias(f"{c}|min"),
            F.max(c).cast("double").alias(f"{c}|max"),
        ]
    row = df.agg(*aggs)
    moments = row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        *[F.col(f"`{c}|{s}`").alias(s) for s in ("count", "mean", "std", "min", "max")],
                    )
                    for c in numeric
                ]
            )
        )
    )
    q = exact_quantiles(df, numeric, [0.25, 0.5, 0.75]).select(
        F.col("feature").alias("column"),
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"),
    )
    out = moments.join(q, "column", "left")
    if text:
        counts = (
            long_levels(df, text).filter(F.col("level").isNotNull()).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
        )
        cats = counts.groupBy(F.col("feature").alias("column")).agg(
            F.sum("n").alias("count"),
            F.count(F.lit(1)).alias("unique"),
            F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("top"),
            F.max("n").alias("freq"),
        )
        out = out.unionByName(cats, allowMissingColumns=True)
    return out


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width counts over each column's own range; the last bin is closed on the right.

    A constant column gets a range of one around its value.  Empty bins are kept with count 0.
    """
    row = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"{c}|lo") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"{c}|hi") for c in columns],
    ).first()
    cells = []
    for c in columns:
        lo, hi = row[f"{c}|lo"], row[f"{c}|hi"]
        if lo is None:
            continue
        cells.append(
            F.struct(F.lit(c).alias("feature"), bin_of(F.col(c).cast("double"), lo, hi, bins).alias("bin"))
        )
    if not cells:
        return df.sparkSession.createDataFrame([], "feature string, bin int, n bigint")
    long = df.select(F.inline(F.array(*cells))).filter(F.col("bin").isNotNull())
    return fill_bins(long.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")), ["feature"], bins)


def bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    pos = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int")
    inside = x.between(F.lit(lo), F.lit(hi))
    return F.when(inside, F.least(pos, F.lit(bins - 1)))


def fill_bins(counts: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Every bin number for every key that occurs."""
    grid = counts.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def monthly_counts(df: DataFrame, date: str) -> DataFrame:
    return (
        df.filter(F.col(date).isNotNull())
        .groupBy(F.date_trunc("month", F.col(date)).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def split_summary(df: DataFrame, date: str, target: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(target).alias("target_rate"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def target_trend(df: DataFrame, date: str, target: str, days: int = 7) -> DataFrame:
    """Daily target rate and its mean over the last ``days`` observed days.

    One row per day after the grouping, so the ordered frame runs over calendar days, not rows.
    """
    daily = df.filter(F.col(date).isNotNull()).groupBy(F.to_date(F.col(date)).alias("day")).agg(F.avg(target).alias("rate"))
    frame = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(-(days - 1), 0)
    return daily.select("day", "rate", F.avg("rate").over(frame).alias("rolling_rate"))


def all_null_columns(df: DataFrame) -> list[str]:
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 0]


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.drop(*all_null_columns(df))


