"""Ordered statistics without a global sort.

Ranks, cumulative sums and exact quantiles need the rows "before" a value.  One window over all rows
would put them in one task, so the work is done in two levels:

1. a cheap quantile sketch gives literal cut points, and every value falls into one range bucket;
2. equal values are counted together (combined before the shuffle, so a value that fills a third of
   the data is one row), cumulated inside the bucket, and shifted by the totals of lower buckets.

Only the bucket totals (features x buckets) are ever ordered as a whole.  The cut points are literals,
so a re-run task puts each row into the same bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.plans.session import bucket_count


def cut_points(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Sketch of bucket borders per column: a list of at most ``buckets`` doubles each."""
    buckets = buckets or bucket_count(df.sparkSession)
    probs = [i / buckets for i in range(1, buckets)]
    sketch = [F.percentile_approx(F.col(c), probs, 2 * buckets).alias(f"q{i}") for i, c in enumerate(columns)]
    row = df.agg(*sketch).first()
    return {c: sorted(set(row[i] or [])) for i, c in enumerate(columns)}


def _bucketed(df: DataFrame, columns: Sequence[str], cuts: dict[str, list[float]]) -> tuple[DataFrame, dict[str, str]]:
    names = {c: f"__bucket_{i}" for i, c in enumerate(columns)}
    splits = []
    for c in columns:
        borders = cuts[c] or [0.0]
        splits.append([float("-inf"), *borders, float("inf")])
    model = Bucketizer(
        inputCols=list(columns),
        outputCols=[names[c] for c in columns],
        splitsArray=splits,
        handleInvalid="keep",
    )
    return model.transform(df), names


def long_values(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """``(keep..., feature, bucket, value)``: one row per non-null value of each column (as double)."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    raw = [f"__v{i}" for i in range(len(columns))]
    marked, names = _bucketed(wide, raw, cut_points(wide, raw, buckets))
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(names[r]).cast("int").alias("bucket"),
            F.col(r).alias("value"),
        )
        for c, r in zip(columns, raw)
    ]
    return marked.select(*keep, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())


def ordered_counts(
    long: DataFrame,
    keys: Sequence[str] = ("feature",),
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per distinct value with counts of the rows below it.

    Columns: keys, bucket, value, ``n``, ``below``, ``total`` and for each entry of ``sums`` the value's
    own sum ``x``, the sum below ``x_below`` and ``x_total``.
    """
    sums = sums or {}
    keys = list(keys)
    measures = ["n", *sums]
    per_value = long.groupBy(*keys, "bucket", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    per_bucket = per_value.groupBy(*keys, "bucket").agg(*[F.sum(m).alias(m) for m in measures])
    lower = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)

    def below(m: str) -> str:
        return "below" if m == "n" else f"{m}_below"

    def total(m: str) -> str:
        return "total" if m == "n" else f"{m}_total"

    offsets = per_bucket.select(
        *keys,
        "bucket",
        *[F.coalesce(F.sum(m).over(lower), F.lit(0)).alias(f"__off_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(total(m)) for m in measures],
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    running = per_value.select(
        *keys,
        "bucket",
        "value",
        *measures,
        *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"__in_{m}") for m in measures],
    )
    return running.join(offsets, [*keys, "bucket"]).select(
        *keys,
        "bucket",
        "value",
        *measures,
        *[(F.col(f"__in_{m}") + F.col(f"__off_{m}")).alias(below(m)) for m in measures],
        *[F.col(total(m)) for m in measures],
    )


def value_table(
    df: DataFrame,
    columns: Sequence[str],
    target: str | None = None,
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Distinct values of every column with counts below, and positives if a 0/1 target is given."""
    keep = [*keys, *([target] if target else [])]
    long = long_values(df if not target else df.filter(F.col(target).isNotNull()), columns, keep, buckets)
    sums = {"pos": F.col(target).cast("long")} if target else None
    return ordered_counts(long, [*keys, "feature"], sums)


def average_rank() -> Column:
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def pick_positions(counted: DataFrame, positions: dict[str, Column], keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Value at given 0-based positions of the sorted column; a position is an expression of ``total``."""
    hits = [
        F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("n")), F.col("value"))).alias(name)
        for name, p in positions.items()
    ]
    return counted.groupBy(*keys).agg(F.first("total").alias("total"), *hits)


# Sketch accuracy and the half-width of the rank interval that is searched exactly.
SKETCH = 10_000
MARGIN = 3.0 / SKETCH


def order_statistics(df: DataFrame, requests: Sequence[tuple[str, float, Callable[[int], list[int]]]]) -> list[list[float | None]]:
    """Exact values at sorted positions without sorting the data.

    A request is ``(column, p, ranks)``: ``ranks(n)`` gives the 0-based positions wanted among the ``n``
    non-null values, all close to the share ``p``.  A sketch brackets each request in a narrow value
    interval; one pass counts the rows below the brackets, and only rows inside them are shuffled and
    ordered.  A bracket that misses (the sketch promises it does not) falls back to the full two-level
    count, so the answer is exact in any case.
    """
    columns = list(dict.fromkeys(c for c, _, _ in requests))
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    by_column = {c: [i for i, r in enumerate(requests) if r[0] == c] for c in columns}
    sketches = []
    for j, c in enumerate(columns):
        probs = [q for i in by_column[c] for q in (max(requests[i][1] - MARGIN, 0.0), min(requests[i][1] + MARGIN, 1.0))]
        sketches += [F.count(x[c]).alias(f"n{j}"), F.percentile_approx(x[c], probs, SKETCH).alias(f"q{j}")]
    row = df.agg(*sketches).first()
    n_of = {c: row[f"n{j}"] for j, c in enumerate(columns)}
    bracket: dict[int, tuple[float, float]] = {}
    for j, c in enumerate(columns):
        if n_of[c]:
            ends = row[f"q{j}"]
            for k, i in enumerate(by_column[c]):
                bracket[i] = (ends[2 * k], ends[2 * k + 1])
    out: list[list[float | None]] = [[None] * len(ranks(1)) for _, _, ranks in requests]
    if not bracket:
        return out
    below = df.agg(*[F.count(F.when(x[requests[i][0]] < F.lit(a), 1)).alias(f"b{i}") for i, (a, _) in bracket.items()]).first()
    buckets = bucket_count(df.sparkSession)
    cells = []
    for i, (a, b) in bracket.items():
        v = x[requests[i][0]]
        part = F.floor((v - F.lit(a)) / F.lit(b - a) * buckets).cast("int") if b > a else F.lit(0)
        cell = F.struct(F.lit(i).alias("request"), part.alias("bucket"), v.alias("value"))
        cells.append(F.when(v.between(F.lit(a), F.lit(b)), cell))
    inside = df.select(F.inline(F.array_compact(F.array(*cells))))
    spots = {i: [r - below[f"b{i}"] for r in requests[i][2](n_of[requests[i][0]])] for i in bracket}
    wanted = [
        F.struct(F.lit(i).alias("wi"), F.lit(k).alias("wk"), F.lit(int(r)).cast("long").alias("wr"))
        for i, ranks in spots.items()
        for k, r in enumerate(ranks)
    ]
    counted = ordered_counts(inside, ["request"])
    hits = (
        counted.select("request", "value", "n", "below", F.explode(F.array(*wanted)).alias("w"))
        .filter((F.col("w.wi") == F.col("request")) & (F.col("below") <= F.col("w.wr")))
        .filter(F.col("w.wr") < F.col("below") + F.col("n"))
        .select("request", F.col("w.wk").alias("k"), "value")
        .collect()
    )
    for r in hits:
        out[r["request"]][r["k"]] = r["value"]
    for i in bracket:
        if any(v is None for v in out[i]):
            c, _, ranks = requests[i]
            counted = value_table(df.select(x[c].alias(c)), [c])
            picks = pick_positions(counted, {f"r{k}": F.lit(int(r)) for k, r in enumerate(ranks(n_of[c]))}).first()
            out[i] = [picks[f"r{k}"] for k in range(len(out[i]))]
    return out


# Up to this many values per column the built-in exact aggregate, which keeps all distinct values in one
# task, is the cheaper plan; the size is counted first.
SMALL_VALUES = 500_000


def quantile_map(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    exact: bool = True,
    small: int = SMALL_VALUES,
    rows: int | None = None,
) -> dict[str, list[float]]:
    """Quantiles per column (linear interpolation, nulls skipped) as driver values; empty columns are left out.

    ``exact=False`` takes the sketch's own answer in a single pass.  ``rows`` passes a row count the caller
    already has.
    """
    if not columns:
        return {}
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    if exact and small:
        most = rows
        if most is None:
            most = max(df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first())
        if most <= small:
            wanted = F.array(*[F.lit(float(p)) for p in probs])
            row = df.agg(*[F.percentile(x[c], wanted).alias(f"q{i}") for i, c in enumerate(columns)]).first()
            return {c: list(row[i]) for i, c in enumerate(columns) if row[i] is not None}
    if not exact:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(probs), SKETCH).alias(c) for c in columns]).first()
        return {c: list(row[c]) for c in columns if row[c] is not None}

    def neighbours(p: float) -> Callable[[int], list[int]]:
        return lambda n: [math.floor(p * (n - 1)), min(math.floor(p * (n - 1)) + 1, n - 1)]

    sizes: dict[str, int] = {}

    def counting(c: str, p: float) -> Callable[[int], list[int]]:
        def ranks(n: int) -> list[int]:
            sizes[c] = n
            return neighbours(p)(n)

        return ranks

    wants = [(c, float(p), counting(c, float(p))) for c in columns for p in probs]
    found = order_statistics(df, wants)
    out: dict[str, list[float]] = {}
    for (c, p, _), (lo, hi) in zip(wants, found):
        if lo is None:
            continue
        h = p * (sizes[c] - 1)
        out.setdefault(c, []).append(lo + (hi - lo) * (h - math.floor(h)))
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True) -> DataFrame:
    """``(feature, q)`` with ``q`` an array aligned with ``probs``."""
    found = quantile_map(df, columns, probs, exact)
    rows = [(c, [float(v) for v in found[c]]) for c in columns if c in found]
    return df.sparkSession.createDataFrame(rows, "feature string, q array<double>")


def rows_at(df: DataFrame, key: str, tie: str, positions: Sequence[int], total: int) -> list[tuple[float, float]]:
    """``(key, tie)`` of the rows at 0-based positions of the order ``key, tie`` (both numeric, no nulls).

    ``total`` is the number of rows.  A heavy key value is not sorted: its rows are only counted, and the
    position inside it is found by the same bracketed search over ``tie``.
    """
    if not positions:
        return []
    frame = df.select(F.col(key).cast("double").alias("k"), F.col(tie).cast("double").alias("t"))
    share = [p / max(total - 1, 1) for p in positions]
    keys = [v[0] for v in order_statistics(frame, [("k", s, lambda n, p=p: [p]) for s, p in zip(share, positions)])]
    heads = sorted(set(keys))
    counts = frame.agg(
        *[F.count(F.when(F.col("k") < F.lit(h), 1)).alias(f"b{i}") for i, h in enumerate(heads)],
        *[F.count(F.when(F.col("k") == F.lit(h), 1)).alias(f"n{i}") for i, h in enumerate(heads)],
    ).first()
    ties = frame.filter(F.col("k").isin(heads)).select(
        *[F.when(F.col("k") == F.lit(h), F.col("t")).alias(f"t{i}") for i, h in enumerate(heads)]
    )
    wants = []
    for k, p in zip(keys, positions):
        i = heads.index(k)
        rest = p - counts[f"b{i}"]
        wants.append((f"t{i}", rest / max(counts[f"n{i}"] - 1, 1), lambda n, r=rest: [r]))
    return [(k, t[0]) for k, t in zip(keys, order_statistics(ties, wants))]
