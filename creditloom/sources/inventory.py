"""Column inventories of tables and folders."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.clean import guess_dates, guess_targets
from creditloom.plans.session import materialize
from creditloom.sources.readers import SUFFIXES, file_profile, list_files, read_dataset, write_report

LOG = logging.getLogger(__name__)
BATCH = 12


def _text(c: Column, kind: T.DataType) -> Column:
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def _counted(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """``i, value_0, ..., n``: how often every value (nulls too) of each column, by its place in ``fields``, occurs.

    Columns of one type share a value column, whole numbers are all longs.  A row holds one value, so what is grouped
    and shuffled is as narrow as that value, and buffers are whole numbers that a hash aggregation updates in place.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = [T.LongType() if isinstance(f.dataType, whole) else f.dataType for f in fields]
    slots = list(dict.fromkeys(kinds))
    cells = []
    for i, (f, kind) in enumerate(zip(fields, kinds)):
        values = [F.col(f"`{f.name}`").cast(kind) if kind == slot else F.lit(None).cast(slot) for slot in slots]
        cells.append(F.struct(F.lit(i).alias("i"), *[v.alias(f"value_{j}") for j, v in enumerate(values)]))
    names = [f"value_{j}" for j in range(len(slots))]
    out = df.select(F.inline(F.array(*cells))).groupBy("i", *names).agg(F.count(F.lit(1)).alias("n"))
    return out.select("i", "n", *[F.col(names[slots.index(kind)]).alias(f"v{i}") for i, kind in enumerate(kinds)])


def _exact_row(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """One row of the rows, and for each column its non-null rows, distinct values and a value, from the counted values."""
    aggs = [F.coalesce(F.sum(F.when(F.col("i") == 0, F.col("n"))), F.lit(0)).alias("__rows")]
    for i, f in enumerate(fields):
        here = (F.col("i") == i) & F.col(f"v{i}").isNotNull()
        aggs += [
            F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"n{i}"),
            F.count(F.when(here, 1)).alias(f"u{i}"),
            F.first(F.when(here, _text(F.col(f"v{i}"), f.dataType)), ignorenulls=True).alias(f"e{i}"),
        ]
    return _counted(df, fields).agg(*aggs)


def _sketched_row(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"u{i}"), F.first(_text(c, f.dataType), ignorenulls=True).alias(f"e{i}")]
    return df.agg(*aggs)


def inventory(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """One row per column: type, null share, distinct count, an example, and name-based roles.

    Exact distinct counts shuffle every distinct value; ``exact=False`` uses the sketch for very large tables.
    """
    columns = df.columns
    targets, dates = set(guess_targets(columns)), set(guess_dates(columns))
    parts = []
    for start in range(0, len(columns), BATCH):
        fields = df.schema.fields[start : start + BATCH]
        row = _exact_row(df, fields) if exact else _sketched_row(df, fields)
        cells = [
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.coalesce(F.round(1 - F.col(f"n{i}") / F.nullif(F.col("__rows"), F.lit(0)), 4), F.lit(0.0)).alias("null_fraction"),
                F.col(f"u{i}").alias("unique"),
                F.col(f"e{i}").alias("example"),
                F.lit(int(f.name in targets)).alias("target_candidate"),
                F.lit(int(f.name in dates)).alias("date_candidate"),
            )
            for i, f in enumerate(fields)
        ]
        parts.append(row.select(F.lit(name).alias("dataset"), F.col("__rows").alias("n_rows"), F.lit(len(columns)).alias("n_cols"), F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def _dataset_of(path: Column, folder: str) -> Column:
    """The dataset a file belongs to: the file, or the folder with a readable suffix it lies in; null for other files."""
    root = folder.rstrip("/").split(":", 1)[-1] + "/"
    at = F.instr(path, root) + len(root)
    endings = "|".join(s[1:] for s in SUFFIXES)
    rel = F.regexp_extract(F.substring(path, at, F.length(path)), rf"(?i)^(.*?\.(?:{endings}))(?:/.*)?$", 1)
    return F.when(rel != "", F.concat(F.substring(path, F.lit(1), at - 1), rel))


def dataset_paths(spark: SparkSession, folder: str) -> list[str]:
    """Readable files below a folder; a folder with a readable suffix (a partitioned table) is one dataset."""
    # Part files are folded to their dataset before anything reaches the driver.
    names = list_files(spark, folder).select(_dataset_of(F.col("path"), folder).alias("path")).filter("path is not null").distinct()
    return sorted(r["path"] for r in names.collect())


def text_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """path, encoding and delimiter of every dataset below a folder; several of one dataset are joined by commas."""
    files = file_profile(spark, folder).withColumn("path", _dataset_of(F.col("path"), folder)).filter("path is not null and length > 0")
    listed = lambda c: F.nullif(F.array_join(F.sort_array(F.collect_set(c)), ","), F.lit("")).alias(c)
    return files.groupBy("path").agg(listed("encoding"), listed("delimiter"))


_ROW = (
    "dataset string, n_rows long, n_cols int, column_name string, dtype string, null_fraction double, unique long, example string, "
    "target_candidate int, date_candidate int, path string, error string"
)


def _kind(exc: Exception) -> str:
    """Spark's name of the error, as its message has it, or else the exception's own."""
    named = re.search(r"\[([A-Z][A-Z_]+)[.\]]", str(exc))
    return named[1] if named else type(exc).__name__


def scan_folder(spark: SparkSession, folder: str, sample_rows: int | None = None, exact: bool = True) -> DataFrame:
    """Inventories of every readable dataset below a folder, with its path, encodings and delimiters.

    A dataset that can't be read is one row with the kind of its error and nothing else known.
    """
    parts, errors = [], []
    for path in dataset_paths(spark, folder):
        name = path.rstrip("/").rsplit("/", 1)[-1]
        try:
            found = inventory(read_dataset(spark, path, sample_rows), name, exact)
            parts.append(materialize(found.withColumn("path", F.lit(path)).withColumn("error", F.lit(None).cast("string")), "inventory"))
        except Exception as exc:
            errors.append((name, *[None] * 9, path, _kind(exc)))
            LOG.warning("dataset %s can't be read: %s", path, errors[-1][-1])
    if not parts and not errors:
        raise ValueError(f"no dataset below {folder}")
    if errors:
        parts.append(spark.createDataFrame(errors, _ROW))
    return reduce(DataFrame.unionByName, parts).join(text_profiles(spark, folder), "path", "left")


def export_inventory(spark: SparkSession, folder: str, output: str) -> str:
    return write_report(scan_folder(spark, folder), output)


__all__: Sequence[str] = ["inventory", "dataset_paths", "text_profiles", "scan_folder", "export_inventory"]
