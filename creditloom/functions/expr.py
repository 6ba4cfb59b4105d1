"""Column helpers that carry the engine's null rules.

A missing value is always NULL: NaN and infinities are turned into NULL at ingest,
a comparison with a missing value is false, and clipping keeps NULL as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def finite(x: Column) -> Column:
    """NULL for NaN and infinities (NaN sorts above infinity in Spark)."""
    return F.when(F.abs(x) < F.lit(INFINITY), x)


def finite_frame(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every floating-point column in one projection."""
    return df.select(
        *[
            finite(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric view of a column; text that does not parse becomes NULL."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DoubleType):
        return F.col(name)
    if isinstance(kind, NUMERIC_TYPES + (T.BooleanType,)):
        return F.col(name).cast("double")
    return F.col(name).try_cast("double")


def flag(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False)).cast("int")


def safe_ratio(num: Column, den: Column) -> Column:
    return finite(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL when a side is constant (``corr`` fails there)."""
    return F.regr_sxy(y, x) / F.nullif(F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x)), F.lit(0.0))


def clip(x: Column, low, high) -> Column:
    """Clip to [low, high]; ``greatest``/``least`` alone would replace a NULL by the bound."""
    y = x
    if low is not None:
        y = F.greatest(y, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        y = F.least(y, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), y)


def compare(x: Column, operator: str, threshold: float) -> Column:
    """Threshold test; an unknown operator means ``>=``."""
    t = F.lit(threshold)
    tests = {">": x > t, "<=": x <= t, "<": x < t, "==": x == t}
    return tests.get(operator, x >= t)


def first_match(columns: list[str], keywords: list[str]) -> str | None:
    """A column whose lower-case name is a keyword, else the first one containing any keyword."""
    by_name = {c.lower(): c for c in columns}
    exact = next((by_name[k] for k in keywords if k in by_name), None)
    if exact is not None:
        return exact
    return next((c for c in columns if any(k in c.lower() for k in keywords)), None)


def containing(columns: list[str], *tokens: str) -> list[str]:
    return [c for c in columns if any(t in c.lower() for t in tokens)]
