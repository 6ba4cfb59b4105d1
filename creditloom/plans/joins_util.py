"""Join shapes shared by several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_dates(keys: DataFrame, states: DataFrame, months: int | None) -> DataFrame:
    """Equi-join on ``ent`` with the date range in the condition: ``ts`` in [app_ts - months, app_ts]."""
    k = keys.select(F.col("ent").alias("__ent"), "app_ts")
    on = (F.col("__ent") == F.col("ent")) & (F.col("ts") <= F.col("app_ts"))
    if months:
        on = on & (F.col("ts") >= F.col("app_ts") - F.make_interval(F.lit(0), F.lit(months)))
    return k.join(states, on).drop("__ent")
