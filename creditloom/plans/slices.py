"""Ordered per-entity windows that survive a heavy entity.

``Window.partitionBy(entity)`` sorts each entity in one task.  When one entity may own a third of the
rows that task never ends, so entities above ``limit_rows`` are cut into slices at day borders.  A frame
of the last ``w`` rows needs at most ``w - 1`` rows from before its slice; exactly those rows are copied
into the slice, take part in the window and are dropped afterwards.  The slice is part of the shuffle
key, so per-entity totals join back without bringing a heavy entity together again.

One counting pass over the entity column decides.  Without a heavy entity, the usual case, the plan is
the plain window with a single shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "__slice"
NULL_SPREAD = 1024
DEFAULT_LIMIT = 1_000_000
# A slice holds at least 1/10,000 of all rows, so the slice table has at most 20,000 rows.
MAX_SLICES = 10_000


class SlicedFrame:
    """Rows marked with their slice number.

    ``rows`` keeps every input row; rows without an entity are spread by hash and get no window result.
    """

    def __init__(
        self,
        df: DataFrame,
        entity: str,
        date: str | None,
        tiebreak: Sequence[str],
        limit_rows: int = DEFAULT_LIMIT,
    ):
        self.entity, self.date = entity, date
        # Without a tiebreak all orderable columns order the rows of one date.
        self.tiebreak = list(tiebreak) or [
            f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType) and f.name not in (entity, date)
        ] or [entity]
        spread = F.pmod(F.xxhash64(*self.tiebreak), F.lit(NULL_SPREAD)).cast("int")
        known = df.filter(F.col(entity).isNotNull())
        size = known.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        self._slices: DataFrame | None = None
        if date and size[0] is not None and size[0] > limit_rows:
            self._slices = self._cut(df, max(limit_rows, -(-size[1] // MAX_SLICES)))
        if self._slices is None:
            self.rows = df.withColumn(SLICE, F.when(F.col(entity).isNull(), spread).otherwise(F.lit(0)))
            return
        cut = self._slices.select(F.col(entity).alias("__who"), "__idx", "__from", "__until")
        dated = df.withColumn("__day", self._day())
        here = (F.col(entity) == F.col("__who")) & F.col("__day").between(F.col("__from"), F.col("__until"))
        marked = dated.join(F.broadcast(cut), here, "left")
        self.rows = marked.select(
            *df.columns,
            F.when(F.col(entity).isNull(), spread).otherwise(F.coalesce("__idx", F.lit(0))).alias(SLICE),
            F.col("__idx").isNotNull().alias("__heavy"),
        )

    def _day(self) -> Column:
        """A missing date sorts last, as it does in the ordered frame."""
        return F.coalesce(F.to_date(F.col(self.date)), F.make_date(F.lit(9999), F.lit(12), F.lit(31)))

    def _cut(self, df: DataFrame, limit: int) -> DataFrame:
        """Slices of the heavy entities: position of the first row, rows, first and last day.

        Days are counted, not rows, and the result is bounded by ``MAX_SLICES``, so it is fetched once and
        every later use is a small local table.
        """
        entity = self.entity
        per_day = (
            df.filter(F.col(entity).isNotNull())
            .groupBy(entity, self._day().alias("__day"))
            .agg(F.count(F.lit(1)).alias("__cnt"))
        )
        whole = Window.partitionBy(entity)
        upto = whole.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
        days = (
            per_day.select(
                "*",
                F.coalesce(F.sum("__cnt").over(upto), F.lit(0)).alias("__run"),
                F.sum("__cnt").over(whole).alias("__all"),
            )
            .filter(F.col("__all") > limit)
            .withColumn("__raw", F.floor(F.col("__run") / limit))
        )
        slices = days.groupBy(entity, "__raw").agg(
            F.min("__run").alias("__start"),
            F.sum("__cnt").alias("__size"),
            F.min("__day").alias("__from"),
            F.max("__day").alias("__until"),
        )
        numbered = slices.select(
            entity, (F.row_number().over(whole.orderBy("__raw")) - 1).alias("__idx"), "__start", "__size", "__from", "__until"
        )
        schema = T.StructType(numbered.schema.fields)
        return df.sparkSession.createDataFrame([tuple(r) for r in numbered.collect()], schema)

    def _order(self, descending: bool = False) -> list[Column]:
        cols = [F.col(self.date).isNull(), F.col(self.date)] if self.date else []
        cols += [F.col(c) for c in self.tiebreak]
        return [c.desc() for c in cols] if descending else [c.asc() for c in cols]

    def _copies(self, carry: int) -> DataFrame:
        """The last ``carry`` rows before each slice, marked with the slice they are copied to."""
        key = [self.entity, SLICE]
        own = self._slices.select(self.entity, F.col("__idx").alias(SLICE), "__start", "__size")
        target = self._slices.select(self.entity, F.col("__idx").alias("__to"), F.col("__start").alias("__begin"))
        backwards = Window.partitionBy(*key).orderBy(*self._order(descending=True))
        tails = (
            self.rows.filter("__heavy")
            .withColumn("__r", F.row_number().over(backwards))
            .filter(F.col("__r") <= carry)
            .join(F.broadcast(own), key)
            .withColumn("__pos", F.col("__start") + F.col("__size") - F.col("__r"))
            # Later slices may be shorter than the frame, so a row can reach several of them.
            .withColumn("__to", F.explode(F.sequence(F.col(SLICE) + 1, F.col(SLICE) + carry)))
        )
        reached = tails.join(F.broadcast(target), [self.entity, "__to"]).filter(F.col("__begin") - F.col("__pos") <= carry)
        return reached.withColumn(SLICE, F.col("__to")).select(*self.rows.columns)

    def trailing(self, lookback: int, columns: dict[str, Callable[[WindowSpec], Column]]) -> "SlicedFrame":
        """Add window columns whose frames reach back at most ``lookback`` rows including the current one."""
        if not columns:
            return self
        rows = self.rows
        copied = self._slices is not None and lookback > 1
        if copied:
            rows = rows.withColumn("__copy", F.lit(False)).unionByName(
                self._copies(lookback - 1).withColumn("__copy", F.lit(True))
            )
        w = Window.partitionBy(self.entity, SLICE).orderBy(*self._order())
        known = F.col(self.entity).isNotNull()
        added = rows.select("*", *[F.when(known, make(w)).alias(name) for name, make in columns.items()])
        self.rows = added.filter(~F.col("__copy")).drop("__copy") if copied else added
        return self

    def attach(self, totals: DataFrame) -> "SlicedFrame":
        """Left-join one-row-per-entity totals; they are repeated per slice so a heavy entity stays split."""
        if self._slices is None:
            per_slice = totals.withColumn(SLICE, F.lit(0))
        else:
            last = self._slices.groupBy(self.entity).agg(F.max("__idx").alias("__last"))
            per_slice = (
                totals.join(F.broadcast(last), self.entity, "left")
                .withColumn(SLICE, F.explode(F.sequence(F.lit(0), F.coalesce("__last", F.lit(0)))))
                .drop("__last")
            )
        self.rows = self.rows.join(per_slice, [self.entity, SLICE], "left")
        return self

    def result(self) -> DataFrame:
        return self.rows.drop("__heavy", SLICE)
