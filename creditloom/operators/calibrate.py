"""Probability calibration: Platt, isotonic, and the better of both.

The isotonic fit pools adjacent violators in parts that merge.  Scores are cut into range buckets; inside a bucket the sorted
scores are pooled in a stream into blocks of rising rates, which are far fewer than the scores.  Lists of blocks of neighbouring
buckets are pooled again, ``FAN`` at a time, until one is left; pooling a list of pooled lists gives what pooling
the scores themselves would give, and only blocks at violating borders change.  A task holds the blocks of its range,
never its scores, and the driver gets the final blocks, the fitted step function.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import metrics as M
from creditloom.operators.models import logistic_fit, sigmoid
from creditloom.plans.ranked import cut_points
from creditloom.plans.session import materialize

FAN = 16


@dataclass
class Calibrator:
    """``slope``/``intercept`` for Platt; for isotonic ``steps``: lowest score, highest score and rate of each block."""

    method: str
    slope: float = 0.0
    intercept: float = 0.0
    steps: list[tuple[float, float, float]] = field(default_factory=list)

    def value(self, x: float) -> float:
        """The isotonic value of one score: the rate of its block, a straight line between two blocks, and the end rates outside."""
        i = bisect_right([s[0] for s in self.steps], x) - 1
        if i < 0:
            return self.steps[0][2]
        low, high, rate = self.steps[i]
        if x <= high or i + 1 == len(self.steps):
            return rate
        following = self.steps[i + 1]
        return rate + (following[2] - rate) * (x - high) / (following[0] - high)

    def apply(self, df: DataFrame, score: str = "p", output: str | None = None) -> DataFrame:
        output = output or score
        if self.method == "platt":
            return df.withColumn(output, sigmoid(F.col(score) * self.slope + self.intercept))
        if self.method == "isotonic":
            return self._stepped(df, score, output)
        return df if output == score else df.withColumn(output, F.col(score))

    def _stepped(self, df: DataFrame, score: str, output: str) -> DataFrame:
        if not self.steps:
            raise ValueError("the isotonic fit saw no rows")
        lows, highs, rates = (list(x) for x in zip(*self.steps))
        x = F.col(score).cast("double")
        # The block is found by binary search among the lowest scores; the first one also takes what lies below.
        splits = [float("-inf"), *lows[1:], float("inf")]
        place = Bucketizer(splits=splits, inputCol="__x", outputCol="__block", handleInvalid="keep")
        if len(self.steps) == 1:
            placed = df.withColumn("__x", x).withColumn("__block", F.lit(0.0))
        else:
            placed = place.transform(df.withColumn("__x", x))
        at = F.col("__block").cast("int")
        high, rate = F.get(F.lit(highs), at), F.get(F.lit(rates), at)
        next_low, next_rate = F.get(F.lit(lows), at + 1), F.get(F.lit(rates), at + 1)
        between = rate + (next_rate - rate) * (F.col("__x") - high) / (next_low - high)
        inside = F.when((F.col("__x") <= high) | next_low.isNull(), rate).otherwise(between)
        own = [F.col(c) for c in df.columns if c != output]
        return placed.select(*own, F.when(F.col("__x").isNotNull() & ~F.isnan("__x"), inside).alias(output))


def _by_score(df: DataFrame, target: str, score: str) -> DataFrame:
    """One weighted row per distinct score: the fits see the same sums from far fewer rows."""
    return (
        df.filter(F.col(target).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(F.col(score).cast("double").alias("__score"))
        .agg(F.sum(F.col(target).cast("double")).alias("__total"), F.count(F.lit(1)).cast("double").alias("__n"))
    )


def fit_platt(df: DataFrame, target: str = "y", score: str = "p") -> Calibrator:
    counts = (
        df.filter(F.col(target).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("__score"), F.col(target).cast("int").alias("__y"))
        .agg(F.count(F.lit(1)).cast("double").alias("__n"))
    )
    counts = materialize(counts, "platt")
    total = counts.agg(F.sum("__n")).first()[0]
    (slope,), intercept = logistic_fit(counts, ["__score"], "__y", "__n", total)
    return Calibrator("platt", slope, intercept)


_BLOCK = "part bigint, low double, high double, total double, n double"


def pool(blocks: Iterator[tuple[float, float, float, float]], held: list[list[float]] | None = None) -> list[list[float]]:
    """Neighbouring blocks (low, high, total, n) in order of score, pooled until their rates rise."""
    held = [] if held is None else held
    for block in blocks:
        held.append(list(block))
        while len(held) > 1 and held[-2][2] * held[-1][3] >= held[-1][2] * held[-2][3]:
            _, high, total, n = held.pop()
            held[-1][1] = high
            held[-1][2] += total
            held[-1][3] += n
    return held


def _pooled(blocks: DataFrame) -> DataFrame:
    """The blocks of every part pooled; parts are read in order of score."""

    def run(batches):
        part, held = None, []

        def done():
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(held), pa.int64()), *(pa.array(c, pa.float64()) for c in columns)], names=["part", "low", "high", "total", "n"]
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high", "total", "n")))
            for own, *block in rows:
                if own != part:
                    if held:
                        yield done()
                    part, held = own, []
                pool(iter([block]), held)
        if held:
            yield done()

    return blocks.repartition("part").sortWithinPartitions("part", "low").mapInArrow(run, _BLOCK)


def isotonic_blocks(df: DataFrame, target: str = "y", score: str = "p", buckets: int | None = None) -> DataFrame:
    """The blocks of the increasing fit: low, high, total and n; rows without score or target are left out."""
    points = materialize(_by_score(df, target, score), "isotonic")
    cuts = cut_points(points, ["__score"], buckets)["__score"]
    bucket = F.lit(0)
    if cuts:
        placed = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__score", outputCol="__bucket", handleInvalid="skip").transform(points)
        bucket = F.col("__bucket")
    else:
        placed = points
    s = F.col("__score")
    blocks = placed.select(
        bucket.cast("long").alias("part"), s.alias("low"), s.alias("high"), F.col("__total").alias("total"), F.col("__n").alias("n")
    )
    parts = len(cuts) + 1
    blocks = _pooled(blocks)
    while parts > 1:
        blocks = _pooled(blocks.withColumn("part", F.floor(F.col("part") / FAN)))
        parts = -(-parts // FAN)
    return blocks.drop("part")


def fit_isotonic(df: DataFrame, target: str = "y", score: str = "p", buckets: int | None = None) -> Calibrator:
    """Increasing step fit; outside the seen scores the end values hold."""
    found = isotonic_blocks(df, target, score, buckets).collect()
    return Calibrator("isotonic", steps=sorted((r["low"], r["high"], r["total"] / r["n"]) for r in found))


def brier_of(c: Calibrator, df: DataFrame, target: str = "y", score: str = "p") -> float:
    made = c.apply(df, score, "__cal")
    return made.agg(F.avg(M.brier(F.col(target).cast("double"), F.col("__cal")))).first()[0]


def fit_best(df: DataFrame, target: str = "y", score: str = "p") -> tuple[Calibrator, dict[str, float]]:
    """Lower Brier score wins, Platt on ties."""
    platt, iso = fit_platt(df, target, score), fit_isotonic(df, target, score)
    found = {"platt_brier": brier_of(platt, df, target, score), "isotonic_brier": brier_of(iso, df, target, score)}
    return (platt if found["platt_brier"] <= found["isotonic_brier"] else iso), found
