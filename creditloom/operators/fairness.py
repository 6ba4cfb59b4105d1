"""Group metrics over sensitive columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.metrics import auc_agg, score_table


def fairness_report(
    df: DataFrame, columns: Sequence[str], target: str, pred: str, score: str | None = None, min_group: int = 50
) -> DataFrame:
    """Count, bad rate, AUC (NULL with one class) and mean score per group; small and missing groups are left out."""
    present = [c for c in columns if c in df.columns]
    cells = [F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("group")) for c in present]
    long = df.select(
        F.col(target).alias("y"),
        F.col(pred).alias("p"),
        (F.col(score) if score else F.lit(None).cast("double")).alias("s"),
        F.inline(F.array(*cells)),
    ).filter(F.col("group").isNotNull())
    keys = ["attribute", "group"]
    sizes = (
        long.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("count"), F.avg("y").alias("bad_rate"), F.avg("s").alias("avg_score"))
        .filter(F.col("count") >= min_group)
    )
    aucs = score_table(long, "y", "p", keys).groupBy(*keys).agg(auc_agg().alias("auc"))
    return sizes.join(aucs, keys, "left")
