"""Join operators of the master table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; an aggregate, so duplicates combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(best).select(*keys, "__last.*").select(*df.columns)


def suffix_clashes(base: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    taken = set(base.columns) - set(keys)
    return right.select(*[F.col(c).alias(f"{c}{suffix}") if c in taken else F.col(c) for c in right.columns])


def left_merge(
    base: DataFrame, right: DataFrame | None, keys: Sequence[str], name: str, order: Sequence[str] = (), dedupe: bool = True
) -> DataFrame:
    """De-duplicate the right side on its keys and left-join on the keys both sides have."""
    if right is None:
        return base
    present = [k for k in keys if k in right.columns]
    if dedupe and present:
        right = keep_last(right, present, list(order) or [c for c in right.columns if c not in present] or present)
    shared = [k for k in present if k in base.columns]
    if not shared:
        return base
    return base.join(suffix_clashes(base, right, shared, f"_{name}"), shared, "left")


def merge_coverage(base: DataFrame, right: DataFrame | None, keys: Sequence[str], name: str) -> DataFrame:
    """``(name, coverage, right_rows)``: share of base rows whose first shared key occurs on the right."""
    spark = base.sparkSession
    if right is None:
        return spark.range(1).select(F.lit(name).alias("name"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("right_rows"))
    present = [k for k in keys if k in right.columns]
    shared = [k for k in present if k in base.columns]
    unique = right.dropDuplicates(present) if present else right
    if not shared:
        return unique.agg(F.lit(name).alias("name"), F.lit(0.0).alias("coverage"), F.count(F.lit(1)).alias("right_rows"))
    k = shared[0]
    seen = unique.groupBy(k).agg(F.count(F.lit(1)).alias("__n"))
    per_key = base.groupBy(k).agg(F.count(F.lit(1)).alias("__rows"))
    joined = per_key.join(seen, k, "full")
    # Counts per key on both sides: the comparison never touches the rows of a heavy key again.
    hit = F.sum(F.when(F.col("__n").isNotNull(), F.col("__rows")))
    return joined.agg(
        F.lit(name).alias("name"),
        (F.coalesce(hit, F.lit(0)) / F.nullif(F.sum("__rows"), F.lit(0))).alias("coverage"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("right_rows"),
    )


def star_join(base: DataFrame, parts: Sequence[tuple[DataFrame | None, str]], key: str) -> DataFrame:
    """Plain left joins in order with a suffix per source; duplicates on the right fan out."""
    for right, suffix in parts:
        if right is not None:
            base = base.join(suffix_clashes(base, right, [key], suffix), key, "left")
    return base


