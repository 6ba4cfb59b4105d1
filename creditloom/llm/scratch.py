"""Tables written once in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditloom.plans import session
from creditloom.plans.session import tune

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back; its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return _written(df, session.scratch_path(df.sparkSession, name))


class Tables:
    """Tables of one job in the shared folder, by name; each is dropped when all that reads it is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = session.scratch_path(self.spark, name)
        return _written(df, self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            held = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            held.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(held, True)
