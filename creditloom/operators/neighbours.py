"""Mutual information of numeric columns with a class, from nearest neighbours.

For every row the distance to its k-th nearest neighbour of the same class is compared with the number of
rows of all classes inside it (digammas of counts instead of binned frequencies).  In one dimension neighbours are
neighbours in order, so nothing is searched:

* equal values of a class are counted together; a value with more than k copies has distance 0;
* values fall into range buckets, and each bucket gets the k nearest values of the buckets on either side (a halo),
  so a window inside the bucket sees all neighbours that matter;
* the rows inside a distance are two cumulative counts, at both ends of it, looked up by placing the ends between the
  values of their range buckets.

No bucket, class or value reaches one task as a whole: a bucket holds its share of distinct values, halos hold ``2 * k``.
Null, NaN and infinities count as 0.  Rows without a class and classes of a single row are left out.  The
neighbour itself lies on the border and is not inside.  Ties are counted as they are, no noise is added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.plans import ranked
from creditloom.plans.session import materialize

#: Terms of the recurrence before the series, which is exact to double precision from there on.
_SHIFT = 10


def digamma(n: Column) -> Column:
    """Digamma of whole numbers from 1."""
    x = n.cast("double") + _SHIFT
    # Denominators of the asymptotic series in even powers.
    series = F.ln(x) - 1 / (2 * x)
    for power, below in ((2, -12), (4, 120), (6, -252), (8, 240), (10, -132)):
        series = series + 1 / (below * F.pow(x, F.lit(power)))
    for j in range(_SHIFT):
        series = series - 1 / (n.cast("double") + j)
    return series


def _place(long: DataFrame, columns: Sequence[str], cuts: dict[str, list[float]], position: str) -> DataFrame:
    """``long`` with the range bucket of ``position`` in the cuts of its feature."""
    names = [f"__at_{i}" for i in range(len(columns))]
    wide = long.select("*", *[F.when(F.col("feature") == c, F.col(position)).alias(n) for c, n in zip(columns, names)])
    marked, buckets = ranked._bucketed(wide, names, {n: cuts[c] for c, n in zip(columns, names)})
    mine = F.coalesce(*[F.when(F.col("feature") == c, F.col(buckets[n])) for c, n in zip(columns, names)])
    return marked.select(*long.columns, mine.cast("int").alias("bucket"))


def _distances(values: DataFrame, k: int) -> DataFrame:
    """Distinct values of each class with the distance ``r`` to the k-th neighbour, with ``k`` at most the class less one."""
    cell = F.struct("value", "n")
    inside = Window.partitionBy("feature", "y", "bucket").orderBy("value")
    from_end = Window.partitionBy("feature", "y", "bucket").orderBy(F.desc("value"))
    numbered = values.select("*", F.row_number().over(inside).alias("__up"), F.row_number().over(from_end).alias("__down"))
    edges = numbered.filter((F.col("__up") <= k) | (F.col("__down") <= k)).groupBy("feature", "y", "bucket")
    edges = edges.agg(
        F.sort_array(F.collect_list(F.when(F.col("__down") <= k, cell))).alias("highest"),
        F.sort_array(F.collect_list(F.when(F.col("__up") <= k, cell))).alias("lowest"),
    )
    # A bucket in the table holds a value at least, so k of them hold the k nearest.
    by_bucket = Window.partitionBy("feature", "y").orderBy("bucket")
    halos = edges.select(
        "feature",
        "y",
        "bucket",
        F.flatten(F.collect_list("highest").over(by_bucket.rowsBetween(-k, -1))).alias("before"),
        F.flatten(F.collect_list("lowest").over(by_bucket.rowsBetween(1, k))).alias("after"),
    )
    near = values.select(
        "*", F.collect_list(cell).over(inside.rowsBetween(-k, -1)).alias("lower"), F.collect_list(cell).over(inside.rowsBetween(1, k)).alias("upper")
    )
    near = near.join(halos, ["feature", "y", "bucket"])
    # Copies of the value itself come first, at distance 0.
    around = F.transform(F.concat("before", "lower", "upper", "after"), lambda x: F.struct(F.abs(x["value"] - F.col("value")).alias("d"), x["n"].alias("n")))
    rest = F.array_sort(around)
    wanted = F.least(F.lit(k), F.col("n_class") - 1)
    start = F.struct((F.col("n") - 1).alias("have"), F.when(F.col("n") - 1 >= wanted, F.lit(0.0)).alias("r"))
    walked = F.aggregate(
        rest,
        start,
        lambda t, x: F.struct(
            (t["have"] + x["n"]).alias("have"), F.when(t["r"].isNotNull(), t["r"]).when(t["have"] + x["n"] >= wanted, x["d"]).alias("r")
        ),
    )
    return near.select("feature", "y", "value", "n", "n_class", wanted.alias("k"), walked["r"].alias("r"))


def neighbour_information(df: DataFrame, columns: Sequence[str], target: str, k: int = 3, buckets: int | None = None) -> DataFrame:
    """feature and mutual_info (natural units, at least 0) of each column with the classes of ``target``."""
    columns = list(columns)
    names = [f"__v{i}" for i in range(len(columns))]
    finite = {n: F.when(F.abs(F.nanvl(F.col(c).cast("double"), F.lit(0.0))) < float("inf"), F.nanvl(F.col(c).cast("double"), F.lit(0.0))) for n, c in zip(names, columns)}
    filled = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("y"), *[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in finite.items()])
    cuts = dict(zip(columns, ranked.cut_points(filled, names, buckets).values()))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(n).alias("value")) for n, c in zip(names, columns)])
    counted = filled.select("y", F.inline(cells)).groupBy("feature", "y", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(_place(counted, columns, cuts, "value"), "neighbour_values")
    # Joined by bucket as well: a join by class alone would deal a class to one task, and the windows inside buckets would stay there.
    sizes = counted.groupBy("feature", "y", "bucket").agg(F.sum("n").alias("n_bucket"))
    n_class = F.sum("n_bucket").over(Window.partitionBy("feature", "y")).alias("n_class")
    values = counted.join(sizes.select("feature", "y", "bucket", n_class).filter("n_class > 1"), ["feature", "y", "bucket"])
    queries = materialize(_distances(values, k), "neighbour_distances")

    # Cumulative counts at the ends: an end below a value at the same place counts less than it, one above counts it too.
    position, r = F.col("value"), F.col("r")
    ends = F.array(
        F.struct(F.lit(-1).alias("sign"), (position - r).alias("position"), F.when(r > 0, 2).otherwise(0).alias("turn")),
        F.struct(F.lit(1).alias("sign"), (position + r).alias("position"), F.when(r > 0, 0).otherwise(2).alias("turn")),
    )
    asked = queries.select("feature", "y", "value", F.inline(ends), F.lit(0).cast("long").alias("weight"))
    points = values.groupBy("feature", "value").agg(F.sum("n").alias("weight"))
    points = points.select(
        "feature", F.lit(None).cast(values.schema["y"].dataType).alias("y"), "value", F.lit(0).alias("sign"), F.col("value").alias("position"), F.lit(1).alias("turn"), "weight"
    )
    placed = _place(asked.unionByName(points), columns, cuts, "position")
    lower = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("feature", "bucket").agg(F.sum("weight").alias("w"))
    offsets = offsets.select("feature", "bucket", F.coalesce(F.sum("w").over(lower), F.lit(0)).alias("offset"))
    order = Window.partitionBy("feature", "bucket").orderBy("position", "turn").rowsBetween(Window.unboundedPreceding, 0)
    reached = placed.select("*", F.sum("weight").over(order).alias("inside")).filter("sign != 0").join(offsets, ["feature", "bucket"])
    found = reached.groupBy("feature", "y", "value").agg(F.sum(F.col("sign") * (F.col("inside") + F.col("offset"))).alias("m"))

    scored = queries.join(found, ["feature", "y", "value"])
    total = F.sum("n")
    mean = lambda x: F.sum(F.col("n") * digamma(F.col(x))) / total
    information = digamma(total) + mean("k") - mean("n_class") - mean("m")
    return scored.groupBy("feature").agg(F.greatest(F.lit(0.0), information).alias("mutual_info"))
