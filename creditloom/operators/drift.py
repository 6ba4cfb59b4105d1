"""Population stability between splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.expr import as_double
from creditloom.operators.stats import bin_of


def psi(
    df: DataFrame,
    split: str,
    base: str,
    others: Sequence[str],
    columns: Sequence[str],
    bins: int = 10,
    shared_bins: bool = False,
) -> DataFrame:
    """``(pair, feature, psi)`` of every other split against the base split.

    By default each split is cut over its own range; ``shared_bins`` uses the base split's range for
    both (values outside fall into the end bins).  Three small grouped passes for all columns together.
    """
    sides = [base, *others]
    rows = df.filter(F.col(split).isin(*sides)).select(F.col(split).alias("side"), *[as_double(df, c).alias(c) for c in columns])
    ranges = {
        r["side"]: r
        for r in rows.groupBy("side")
        .agg(*[F.min(c).alias(f"{c}|lo") for c in columns], *[F.max(c).alias(f"{c}|hi") for c in columns])
        .collect()
    }
    cells = []
    for c in columns:
        number = F.lit(None).cast("int")
        for s in sides:
            own = ranges.get(base if shared_bins else s)
            if own is None or own[f"{c}|lo"] is None:
                continue
            lo, hi = own[f"{c}|lo"], own[f"{c}|hi"]
            x = F.col(c)
            if shared_bins:
                x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
            number = F.when(F.col("side") == s, bin_of(x, lo, hi, bins)).otherwise(number)
        cells.append(F.struct(F.lit(c).alias("feature"), number.alias("bin")))
    counts = (
        rows.select("side", F.inline(F.array(*cells)))
        .filter(F.col("bin").isNotNull())
        .groupBy("feature", "bin")
        .agg(*[F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"n{i}") for i, s in enumerate(sides)])
    )
    whole = Window.partitionBy("feature")
    shares = counts.select(
        "feature", *[(F.col(f"n{i}") / F.nullif(F.sum(f"n{i}").over(whole), F.lit(0))).alias(f"s{i}") for i in range(len(sides))]
    )
    gaps = [
        (F.sum((F.col(f"s{i}") - F.col("s0")) * F.ln((F.col(f"s{i}") + 1e-6) / (F.col("s0") + 1e-6)))).alias(f"psi{i}")
        for i in range(1, len(sides))
    ]
    wide = shares.groupBy("feature").agg(*gaps)
    pairs = [F.struct(F.lit(f"{base}_{s}").alias("pair"), F.col(f"psi{i}").alias("psi")) for i, s in enumerate(others, start=1)]
    return wide.select("feature", F.inline(F.array(*pairs)))
