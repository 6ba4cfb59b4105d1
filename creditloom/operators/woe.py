"""Quantile binning, monotone weight of evidence and information value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.expr import as_double
from creditloom.plans.gram import correlations
from creditloom.plans.ranked import quantile_map

SMOOTH = 1e-6


def bin_edges(
    df: DataFrame, columns: Sequence[str], bins: int = 5, exact: bool = True, rows: int | None = None
) -> dict[str, list[float]]:
    """Unique quantile edges; constant and empty columns are left out."""
    probs = [i / bins for i in range(bins + 1)]
    edges = {c: sorted(set(q)) for c, q in quantile_map(df, columns, probs, exact, rows=rows).items()}
    return {c: edges[c] for c in columns if len(edges.get(c, [])) >= 2}


def bin_number(x: Column, edges: Sequence[float]) -> Column:
    """1-based right-closed bin, the lowest edge included; NULL outside the edges."""
    out = F.when((x < edges[0]) | (x > edges[-1]), F.lit(None).cast("int"))
    for i, e in enumerate(edges[1:], start=1):
        out = out.when(x <= e, F.lit(i))
    return out


def assign_bins(df: DataFrame, edges: dict[str, list[float]], suffix: str = "_bin") -> DataFrame:
    return df.select("*", *[bin_number(as_double(df, c), e).alias(f"{c}{suffix}") for c, e in edges.items()])


def woe_table(df: DataFrame, edges: dict[str, list[float]], target: str, min_samples: int = 50) -> DataFrame:
    """One row per kept bin: counts, raw and monotone WOE, and its IV part.

    Bins with too few rows or without bads are dropped before the totals; WOE never falls from one
    kept bin to the next.
    """
    cells = [
        F.struct(F.lit(c).alias("feature"), bin_number(as_double(df, c), e).alias("bin")) for c, e in edges.items()
    ]
    long = df.select(F.col(target).cast("double").alias("y"), F.inline(F.array(*cells)))
    counts = (
        long.filter(F.col("bin").isNotNull() & F.col("y").isNotNull())
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("bad"))
        .filter((F.col("n") >= min_samples) & (F.col("bad") > 0))
        .withColumn("good", F.col("n") - F.col("bad"))
    )
    own = Window.partitionBy("feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    shares = counts.select(
        "*", F.sum("bad").over(own).alias("__b"), F.sum("good").over(own).alias("__g")
    ).filter(F.col("__g") > 0)
    bad, good = F.col("bad") / F.col("__b"), F.col("good") / F.col("__g")
    raw = shares.select("*", F.ln((bad + SMOOTH) / (good + SMOOTH)).alias("woe_raw"))
    mono = raw.select("*", F.max("woe_raw").over(upto).alias("woe"))
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("bin"), F.lit(float(e[i - 1])).alias("lo"), F.lit(float(e[i])).alias("hi"))
        for c, e in edges.items()
        for i in range(1, len(e))
    ]
    limits = df.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    return mono.join(limits, ["feature", "bin"]).select(
        "feature", "bin", "lo", "hi", "n", "bad", "good", "woe_raw", "woe", ((bad - good) * F.col("woe")).alias("iv_part")
    )


def iv_ranking(table: DataFrame) -> DataFrame:
    return table.groupBy("feature").agg(F.sum("iv_part").alias("iv")).orderBy(F.desc("iv"), "feature")


@dataclass(frozen=True)
class WoeModel:
    """Fitted edges and WOE values: at most bins numbers per feature, kept on the driver."""

    edges: dict[str, list[float]]
    woe: dict[str, dict[int, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], target: str, bins: int = 5, min_samples: int = 50, rows: int | None = None) -> "WoeModel":
        edges = bin_edges(df, columns, bins, rows=rows)
        return cls.from_table(edges, woe_table(df, edges, target, min_samples)) if edges else cls({}, {})

    @classmethod
    def from_table(cls, edges: dict[str, list[float]], table: DataFrame) -> "WoeModel":
        woe: dict[str, dict[int, float]] = {}
        for r in table.select("feature", "bin", "woe").collect():
            woe.setdefault(r["feature"], {})[r["bin"]] = r["woe"]
        return cls(edges, {c: woe[c] for c in edges if c in woe})

    @property
    def features(self) -> list[str]:
        return list(self.woe)

    def encode(self, x: Column, feature: str) -> Column:
        """0 for a missing value, a value outside the edges and a dropped bin."""
        number = bin_number(x, self.edges[feature])
        out = None
        for b, w in sorted(self.woe[feature].items()):
            out = F.when(number == b, F.lit(w)) if out is None else out.when(number == b, F.lit(w))
        return out.otherwise(F.lit(0.0))

    def transform(self, df: DataFrame, suffix: str = "_woe") -> DataFrame:
        return df.select("*", *[self.encode(as_double(df, c), c).alias(f"{c}{suffix}") for c in self.features if c in df.columns])


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, ignoring rows where either is missing; one scan for any number of columns."""
    return correlations(df, columns)


def correlation_filter(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Columns to drop: the later one of any pair correlated above the threshold."""
    return (
        correlation_pairs(df, columns)
        .filter(F.abs("corr") > threshold)
        .groupBy(F.col("right").alias("column"))
        .agg(F.max(F.abs("corr")).alias("max_abs_corr"))
    )


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information with the target in nats over quantile bins; a missing value is its own bin."""
    edges = bin_edges(df, columns, bins)
    cells = [
        F.struct(F.lit(c).alias("feature"), F.coalesce(bin_number(as_double(df, c), e), F.lit(0)).alias("bin"))
        for c, e in edges.items()
    ]
    cellwise = (
        df.filter(F.col(target).isNotNull())
        .select(F.col(target).cast("int").alias("y"), F.inline(F.array(*cells)))
        .groupBy("feature", "bin", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    f = Window.partitionBy("feature")
    joint = cellwise.select(
        "feature",
        "n",
        F.sum("n").over(f).alias("t"),
        F.sum("n").over(Window.partitionBy("feature", "bin")).alias("nx"),
        F.sum("n").over(Window.partitionBy("feature", "y")).alias("ny"),
    )
    part = F.col("n") / F.col("t") * F.ln(F.col("n").cast("double") * F.col("t") / (F.col("nx").cast("double") * F.col("ny")))
    return joint.groupBy("feature").agg(F.sum(part).alias("mutual_info"))
