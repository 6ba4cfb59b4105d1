"""Sums over all pairs of columns from one scan.

Each task multiplies its batches as matrices and keeps six sums for every pair of columns over the rows where both are
present: their number, the sums of either side, of the squares and of the product.  Columns are shifted by their means first, which keeps
the precision of large, nearly equal values.  A task sends one row per column, whatever its number of rows; rows of one column
are added up in a stream.  So the scan is read once for any number of columns, and nothing but the
means comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.expr import as_double

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_ROW = "i int, " + ", ".join(f"{s} array<double>" for s in SUMS)
#: Squared deviations below this share of the squares are rounding errors of a constant column.
CONSTANT = 1e-22


def _batch(i: list[int], sums: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([row[k] for row in sums], pa.list_(pa.float64())) for k in range(len(SUMS))]
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), *columns], names=["i", *SUMS])


def pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """left, right, n, sx, sy, sxx, syy, sxy for every pair in the order of ``columns``; sums are of values less their column's mean.

    Missing values and NaN leave a row out of the pairs of their column.
    """
    names = list(columns)
    schema = "left string, right string, mx double, my double, " + ", ".join(f"{s} double" for s in SUMS)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    x = df.select(*[F.nanvl(as_double(df, c), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(names)])
    means = [m or 0.0 for m in x.agg(*[F.avg(c).alias(c) for c in x.columns]).first()]
    center = np.array(means)

    def multiply(batches):
        sums = None
        for batch in batches:
            values = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]) - center
            there = ~np.isnan(values)
            values[~there] = 0.0
            there = there.astype(float)
            square = values * values
            part = [there.T @ there, values.T @ there, None, square.T @ there, None, values.T @ values]
            sums = part if sums is None else [a if a is None else a + b for a, b in zip(sums, part)]
        if sums is not None:
            n, s, _, q, _, p = sums
            for i in range(len(names) - 1):
                yield _batch([i], [[n[i, i + 1 :], s[i, i + 1 :], s[i + 1 :, i], q[i, i + 1 :], q[i + 1 :, i], p[i, i + 1 :]]])

    def add(batches):
        at, held = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                i = batch.column(0)[r].as_py()
                row = [batch.column(k)[r].values.to_numpy() for k in range(1, len(SUMS) + 1)]
                if i == at:
                    held = [a + b for a, b in zip(held, row)]
                    continue
                if at is not None:
                    yield _batch([at], [held])
                at, held = i, row
        if at is not None:
            yield _batch([at], [held])

    added = x.mapInArrow(multiply, _ROW).repartition("i").sortWithinPartitions("i").mapInArrow(add, _ROW)
    pairs = added.select("i", F.posexplode(F.arrays_zip(*SUMS)).alias("j", "s"))
    labels, mean = F.array(*[F.lit(c) for c in names]), F.array(*[F.lit(float(m)) for m in means])
    j = F.col("i") + F.col("j") + 1
    return pairs.select(
        F.get(labels, F.col("i")).alias("left"),
        F.get(labels, j).alias("right"),
        F.get(mean, F.col("i")).alias("mx"),
        F.get(mean, j).alias("my"),
        "s.*",
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """left, right and Pearson correlation of every column pair over the rows where both are present; NULL when a side is constant there."""
    n = F.nullif(F.col("n"), F.lit(0.0))

    def spread(s: str, q: str, m: str):
        rest = F.col(q) - F.col(s) * F.col(s) / n
        return F.when(rest > CONSTANT * (F.col(q) + n * F.col(m) * F.col(m)), F.sqrt(rest))

    both = F.col("sxy") - F.col("sx") * F.col("sy") / n
    return pair_sums(df, columns).select("left", "right", (both / spread("sx", "sxx", "mx") / spread("sy", "syy", "my")).alias("corr"))
