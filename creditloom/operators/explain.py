"""Coefficients, reason codes and scorecard points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.expr import as_double
from creditloom.functions.scorecard import PointsScale
from creditloom.operators.models import Champion
from creditloom.operators.woe import woe_table


def coefficient_table(df: DataFrame, model: Champion) -> DataFrame:
    rows = [(c, float(b)) for c, b in zip(model.features, model.coefficients)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def reason_codes(contributions: dict[str, Column], top_k: int = 3) -> Column:
    """The ``top_k`` largest contributions by absolute value; the smaller name first on ties."""
    cells = [
        F.struct((-F.abs(c)).alias("order"), F.lit(name).alias("feature"), c.alias("contribution"))
        for name, c in contributions.items()
    ]
    best = F.slice(F.sort_array(F.array(*cells)), 1, top_k)
    return F.transform(best, lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution")))


def champion_reasons(model: Champion, df: DataFrame, keys: Sequence[str], top_k: int = 3) -> DataFrame:
    """Reason codes for every row: WOE value times coefficient."""
    parts = {c: model.woe.encode(as_double(df, c), c) * F.lit(b) for c, b in zip(model.features, model.coefficients)}
    return df.select(*keys, reason_codes(parts, top_k).alias("factors"))


def explanation(model: Champion, df: DataFrame, keys: Sequence[str], top_k: int = 3) -> DataFrame:
    """All that explains the champion in one table: its intercept, its coefficients, and the reason codes of every row.

    Columns: section (``intercept``, ``coefficient``, ``reason``), the keys (null outside reasons), position (from 1; that
    of a feature in the model or of a reason in its row), feature and value.
    """
    numbers = [("intercept", None, None, float(model.intercept))]
    numbers += [("coefficient", i, c, float(b)) for i, (c, b) in enumerate(zip(model.features, model.coefficients), 1)]
    fitted = df.sparkSession.createDataFrame(numbers, "section string, position int, feature string, value double")
    none = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
    reasons = champion_reasons(model, df, keys, top_k).select(*keys, F.posexplode("factors").alias("i", "f"))
    coded = reasons.select(F.lit("reason").alias("section"), *keys, (F.col("i") + 1).alias("position"), "f.feature", F.col("f.contribution").alias("value"))
    return fitted.select("section", *none, "position", "feature", "value").unionByName(coded)


def scorecard_table(model: Champion, train: DataFrame, target: str, cfg: PointsScale = PointsScale(), min_samples: int = 50) -> DataFrame:
    """Points per bin: coefficient x factor next to the WOE table of the training rows."""
    edges = {c: model.woe.edges[c] for c in model.features}
    bins = woe_table(train, edges, target, min_samples)
    even, slope = cfg.line()
    points = coefficient_table(train, model).select("feature", "coefficient", (F.col("coefficient") * slope).alias("points"))
    return bins.join(F.broadcast(points), "feature").select(
        "feature", "bin", "lo", "hi", "n", "bad", "woe", "coefficient", "points", F.lit(slope).alias("factor"), F.lit(even).alias("offset")
    )
